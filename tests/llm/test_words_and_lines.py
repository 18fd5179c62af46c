"""Line dedup, spelling variants and phrases against plain Python and on odd rows."""
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import lines, phrases, spelling
from lanewise.session import share_code

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(30_000))
CLASH = ["h1", "h2", "pos", "first", "batch", "line", "docs", "keeper", "text_hash", "word", "n", "near", "body", "part", "words", "phrase", "a", "l"]
SHARED = "This line is shared by several documents"
ROWS = [  # nulls in every column, empty texts, ties, repeated rows, one very long text
    (1, f"{SHARED}\nown line of the first document\n\nshort", "en"), (2, f"\t{SHARED.upper()} \r\nshort\n{SHARED}", "en"),
    (2, f"{SHARED}\nshort", None), (2, f"{SHARED}\nshort", None), (None, f"{SHARED}\nheld without an id three times", "fr"),
    (None, "held without an id three times", "fr"), (None, "held without an id three times\nheld without an id three times", None),
    (5, None, "en"), (6, "", None), (7, "\n\n", "de"), (8, LONG, "en"), (9, "Évidence évidence, evidences! EVIDENCES; evidencess évidence ×÷×÷×÷×", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    share_code(spark)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def docs(spark):
    share_code(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- lines ----

def plain_lines(rows, least=20, min_docs=3):
    held = defaultdict(list)
    for i, text in rows:
        for key in {small(x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n")}:
            if len(key) >= least:
                held[key].append(i)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        keys = [small(x.strip(" \t\n\x0b\x0c\r")) for x in all_lines]
        kept = [x for x, k in zip(all_lines, keys) if k not in keeper or keeper[k] == i]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def spark_rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("batch_rows", [50_000_000, 20])
def test_lines(docs, monkeypatch, batch_rows):
    monkeypatch.setattr(lines, "BATCH_ROWS", batch_rows)
    want = plain_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert spark_rows(lines.deduplicate_lines(docs)) == want and sum(r[2] for r in want) > 0


def test_lines_odd(odd):
    got = spark_rows(lines.deduplicate_lines(odd))
    assert got == plain_lines([(r[0], r[1]) for r in ROWS])
    assert got[(None, 2, 1, "held without an id three times")] == 1  # missing ids come below all others and keep what they alone hold
    assert got[(5, 1, 0, "")] == 1 and got[(6, 1, 0, "")] == 1
    assert not lines.deduplicate_lines(odd.limit(0)).head(1)


def test_line_runs_settle_and_merge(spark):
    ledger = lines.LineRuns(spark, settled=3)
    for batch, docs in enumerate([1, 1, 5, 2, 4]):  # key 0 is in every batch, the others in one each
        rows = [(0, 0, docs, 100 - batch), (batch + 1, 7, 1, 50 - batch)]
        ledger.add(spark.createDataFrame(rows, "h1 long, h2 long, docs long, keeper long"))
    assert [len(v) for _, v in sorted(ledger.levels.items())] == [1, 0, 1]  # five batches: runs of one and of four
    kept = {(r.h1, r.docs) for run in ledger.runs() for r in run.collect()}
    assert (0, 7) in kept and not {(0, 2), (0, 4)} & kept  # settled by the third batch, so the later ones leave it out
    assert [tuple(r) for r in ledger.frequent().collect()] == [(0, 0, 100)]


def test_line_joins_do_not_move_the_runs(spark):
    ledger = lines.LineRuns(spark)
    ledger.add(spark.range(1000).selectExpr("id AS h1", "id AS h2", "1L AS docs", "id AS keeper"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = spark.range(1000).selectExpr("id AS h1", "id AS h2").groupBy("h1", "h2").count()
        plan = ledger.unsettled(keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1


# ---- spelling ----

def plain_words(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = small(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def plain_variants(n):
    near, gaps = defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1:]].append(w)
            if w[:i] + w[i + 1:] in n:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for some in gaps.values():
        for a in some:
            near[a].update(b for b in some if b != a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def variants(df):
    return {r.word: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 2_048])
def test_variants(docs, filter_bytes):
    n = plain_words([(r.doc_id, r.text) for r in docs.collect()])
    got = variants(spelling.spelling_variants(docs, filter_bytes=filter_bytes))
    assert got == plain_variants(n) and len(got) > 1_000


def test_chains_of_forms_end_in_their_root(spark):
    share_code(spark)
    text = " ".join(w for w, n in [("abcdefgh", 2), ("abcdefghi", 25), ("abcdefghij", 300), ("zbcdefghij", 300), ("öbcdefghij", 29)] for _ in range(n))
    df = spark.createDataFrame([(i, text) for i in (3, 4)], "doc_id long, text string")
    n = plain_words([(i, text) for i in (3, 4)])
    got = variants(spelling.spelling_variants(df))
    assert got == plain_variants(n) and any(root not in (w, form) for w, (form, root, *_) in got.items())


def test_variants_odd(odd):
    got = variants(spelling.spelling_variants(odd))
    assert got == plain_variants(plain_words([(r[0], r[1]) for r in ROWS])) and "évidence" in got
    assert not spelling.spelling_variants(odd.limit(0)).head(1)


def test_long_words_are_probed_as_a_whole(spark):
    share_code(spark)
    long = "ab" * 20_000
    df = spark.createDataFrame([(1, f"{long} {long[:-1]} {long}"), (2, f"{long[:-1]} {long[:9]}")], "doc_id long, text string")
    assert variants(spelling.spelling_variants(df)) == plain_variants(plain_words([(r.doc_id, r.text) for r in df.collect()]))


def test_filters_hold_every_word_and_few_others():
    rng = np.random.default_rng(5)
    inside, outside = rng.integers(97, 123, (2, 20_000, 9), dtype=np.uint8)
    for shards in (spelling.shards_of({9: 20_000})[0], [s for p in spelling.shards_of({9: 20_000}, 20_000) for s in p]):
        h = spelling.scrambled(spelling.grid_hash(inside))
        found = np.zeros(20_000, int)
        false = 0
        for shard in shards:
            mine = h if shard.parts == 1 else h[shard.holds(h)]
            table = np.zeros(shard.slots, np.uint64)
            np.bitwise_or.at(table, spelling.slot_of(mine, shard.slots), spelling.mask_of(mine))
            found[spelling.probe(spelling.grid_hash(inside), shard, table)] += 1
            false += len(spelling.probe(spelling.grid_hash(outside), shard, table))
        assert (found == 1).all() and false < 200


# ---- phrases ----

def plain_phrases(rows, least=30, top=2_000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0A-\x0D]", small(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for size in range(1, 5):
                f[lang or "und"].update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in cands.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longest[p[i:i + size]] = max(longest[p[i:i + size]], a)
        scored = []
        for p, a in cands.items():
            if 100 * longest[p] < 80 * a:
                cut = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-cut[0], -a, " ".join(p).encode(), counts[p[:cut[1]]], counts[p[cut[1]:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return Counter(out)


@pytest.mark.parametrize("range_chars,least", [(phrases.RANGE_CHARS, 30), (2_000, 4)])
def test_phrases(docs, monkeypatch, range_chars, least):
    if least < 30:  # small portions and folds
        monkeypatch.setattr(phrases, "UNION_ROWS", 500)
    want = plain_phrases([(r.lang, r.text) for r in docs.collect()], least)
    assert spark_rows(phrases.collocations(docs, min_count=least, range_chars=range_chars)) == want and len(want) > 20


def test_phrases_odd(odd, spark):
    got = spark_rows(phrases.collocations(odd, min_count=2))
    assert got == plain_phrases([(r[2], r[1]) for r in ROWS], 2) and any(r[0] == "und" for r in got)
    assert not phrases.collocations(odd.limit(0)).head(1)
    assert not phrases.collocations(odd.where("text IS NULL")).head(1)


def test_counts_beyond_64_bits_of_product(spark):
    rows = spark.createDataFrame([(4 * 10 ** 18, 9 * 10 ** 18)], "a long, both long")
    assert rows.select(phrases._score(F.col("a"), F.col("both"))).first()[0] == 2_000_000 * 4 // 9


def test_transducers_round_trip_unite_and_compose():
    rng = np.random.default_rng(3)
    texts = [[" ".join(rng.choice(list("abcdefg"), 60)).replace("g", ".") for _ in range(30)] for _ in range(4)]
    packed = []
    for t in texts:
        words, rows, weights = phrases.windows_of(t)
        one = phrases.Transducer(words, rows, weights).packed()
        back = phrases.unpacked(one["words"], one["arrays"])
        order = np.lexsort(back[1].T[::-1])
        assert back[0] == words and (back[1][order] == rows).all() and (back[2][order] == weights).all()
        packed.append((one["words"], one["arrays"]))
    whole = phrases.united(iter(packed))
    count = Counter()
    for t in texts:
        for piece in ".".join(t).split("."):
            w = piece.split()
            for size in range(1, 5):
                count.update(" ".join(w[i:i + size]).encode() for i in range(len(w) - size + 1))
    assert dict(phrases.frequent_states(whole, 1)) == dict(count)
    rows, weights = phrases.windows_of([x for t in texts for x in t])[1:]
    assert (whole.compose(rows) == weights).all() and not whole.compose(np.array([[-1, 0, 0, 0], [1, -1, 0, 0]])).any()
