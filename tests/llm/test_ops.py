"""The ten operators against brute force, exact round trips and held-out labels."""

import hashlib
import html
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import anchors, jpeg, oracle, pfor, toxicity
from scholia.llm.best_fit_packing import best_fit_decreasing, lower_bound, pack_documents
from scholia.llm.components import components
from scholia.llm.common import Workspace
from scholia.llm.html_extraction import extract_pages, main_text
from scholia.llm.license_scan import license_scan
from scholia.llm.media_columns import media_column, media_features, padded
from scholia.llm.mix_sources import mix_sources, mixed_documents
from scholia.llm.ngram_join import Edits, Meeting, Trie, distinct, one_of_each, similar_documents
from scholia.llm.quality_rules import kept_documents, quality_rules
from scholia.llm.queries import QUERIES
from scholia.llm.suffix_dedup import deduplicated, suffix_dedup
from scholia.llm.token_files import read_token_files, write_token_files
from scholia.llm.tokens import Encoder, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and long texts, ties and repeated rows.
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 6), (4, "word " * 30000, "en", "s", 150000),
    (5, "same text here with more than five words", "en", "s", 40), (6, "same text here with more than five words", "en", "t", 40),
    (6, "same text here with more than five words", "en", "t", 40), (None, "same text here with more than five words", "en", "t", 40),
    (7, "a a a a a a a a " * 40, "en", None, 640), (8, "é" * 300, "fr", "t", 300), (9, "  double  spaces \n kept <|endoftext|> here ", "en", "t", 44),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", ["op8_quality_rules", "op9_mix_sources"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(oracle.SQL[name]).df()
    key = lambda d: d[sorted(want.columns)].astype(str).sort_values(sorted(want.columns)).values.tolist()
    assert key(got) == key(want)


def test_license_base_columns(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(oracle.OP3_BASE).df()
    got = license_scan(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()[list(want.columns)]
    places = ["first_word", "last_word"]

    def key(d):
        d[places] = d[places].astype("float64").fillna(-1)
        return d.sort_values("doc_id").values.tolist()

    assert key(got) == key(want)


def test_license_finds_edited_notice(spark):
    text = "x y z permission is hereby granted free of any charge to any person obtaining a copy of this software and its associated documentation files the software to deal in the software without restriction end"
    got = license_scan(spark.createDataFrame([(1, text), (2, "nothing of the sort")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["labels"] == "mit-header" and got[0]["score"] > 0.8 and got[0]["n_base"] == 0
    assert got[1]["labels"] == "" and got[1]["score"] == 0.0 and got[1]["first_word"] is None


def test_odd_rows(spark, odd, empty):
    n = len(ODD)
    for op in (license_scan, lambda d: quality_rules(d).drop("text"), mix_sources, similar_documents, suffix_dedup,
               lambda d: media_features(media_column(d)), lambda d: read_token_files(write_token_files(d))):
        assert op(odd).count() == n
        assert op(empty).count() == 0
    assert pack_documents(odd).where("start = 0").count() == n and pack_documents(empty).count() == 0
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))
    assert extract_pages(pages).count() == n and extract_pages(pages.limit(0)).count() == 0
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, labels).count() == n and toxicity.toxicity(empty, labels).count() == 0
    for op in (kept_documents, one_of_each, deduplicated, mixed_documents):
        assert op(odd).columns == odd.columns and op(empty).count() == 0


def test_mix_is_exact(odd, docs):
    for d in (docs, odd):
        got = mix_sources(d).toPandas()
        total = got["size"].sum()
        per = got.groupby("source", dropna=False).agg({"size": "sum", "taken": "sum", "target": "max"})
        assert abs(per["target"].sum() - total) < 1e-6 * total
        assert (abs(per["taken"] - per["target"]) <= 0.5 + 1e-9).all() and (got["taken"] <= 3 * got["size"]).all()
    mixed = mixed_documents(docs).toPandas()
    assert sum(len(t.split()) for t in mixed["text"]) == mix_sources(docs).toPandas()["taken"].sum()


def test_mixed_documents_take_what_the_mix_takes(spark):
    """Repeated ids with different texts and sources, repeated rows, null ids and sources."""
    rng = np.random.default_rng(2)
    rows = [(1, 10, "s"), (1, 1, "t"), (2, 30, "s"), (3, 2, "t"), (3, 2, "t"), (3, 2, "t"), (None, 7, None), (None, 7, None), (None, 9, "s"), (4, 5, None)]
    rows += [(int(rng.integers(5, 30)), int(rng.integers(0, 40)), "stuv"[rng.integers(0, 4)]) for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(n)), s) for i, n, s in rows], "doc_id long, text string, source string")
    taken = mix_sources(df).toPandas()
    mixed = mixed_documents(df.withColumn("taken", F.lit(1)).withColumn("key", F.lit("k")).withColumn("row", F.lit(2))).toPandas()
    assert list(mixed.columns) == ["doc_id", "text", "source", "taken", "key", "row"]
    mixed["n"] = mixed["text"].str.split().str.len()
    assert mixed["n"].sum() == taken["taken"].sum()
    by = ["doc_id", "source"]
    want = taken[taken["taken"] > 0].groupby(by, dropna=False)["taken"].sum()
    got = mixed.groupby(by, dropna=False)["n"].sum()
    assert got.to_dict() == want.to_dict() or dict(zip(map(str, got.index), got)) == dict(zip(map(str, want.index), want))


def test_stages_with_clashing_columns(spark, docs):
    """Extra columns with the names that the stages use themselves change nothing."""
    names = ["_w", "_lines", "_tri", "_at", "places", "taken", "size", "key", "th", "row", "doc", "rest", "steps", "number", "kept", "again", "sid", "cut", "words", "blank"]
    few = docs.where("doc_id < 60")
    more = few.withColumns({n: F.lit(n) for n in names})
    for op in (kept_documents, one_of_each, deduplicated, mixed_documents):
        got = op(more)
        assert got.columns == more.columns
        plain = sorted(map(str, (tuple(r) for r in op(few).collect())))
        assert sorted(map(str, (tuple(r) for r in got.select(*few.columns).collect()))) == plain
        assert got.where(" OR ".join(f"`{n}` <> '{n}'" for n in names)).count() == 0


def test_suffix_dedup_brute_force(spark, rows):
    extra = [(1000, "ab" * 400), (1001, rows[0][1][30:400] + "é" * 90 + rows[1][1][:300]), (1002, "ab" * 60), (-5, rows[2][1])]
    given = sorted(rows + extra)
    got = {r["doc_id"]: r for r in suffix_dedup(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    seen = set()
    for name, text in given:
        data = text.encode()
        keep = np.ones(len(data), dtype=bool)
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                keep[i : i + 100] = False
            seen.add(w)
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[keep])
        spans = int(np.count_nonzero(np.diff(np.concatenate(([1], keep.astype(int)))) < 0))
        r = got[name]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()), name


def test_hot_chunks_meet(monkeypatch):
    """Anchor groups over the chunk size: what chunks leave first meets by the windows' hashes."""
    import pyarrow as pa

    import scholia.llm.suffix_dedup as S

    monkeypatch.setattr(S, "CHUNK", 4)
    line = "the very common line that stands in all of these documents, with enough bytes to fill one whole window and some more of them."
    texts = [f"{i} {i * i} start {line} end {i * 7} {i}".encode() for i in range(60)]
    at, start, count, repeats, least, content = anchors.segments(texts)
    m, seg, pos = least.view(np.int64), content.view(np.int64), start * 256 + repeats * 128 + count
    o = np.lexsort((pos, at, seg, m))
    rows = pa.RecordBatch.from_arrays(
        [pa.array(m[o]), pa.array(seg[o]), pa.array(at[o]), pa.array(np.zeros(len(o), dtype=np.int64)), pa.array(pos[o])], names=["m", "seg", "doc", "th", "pos"])
    found = pa.Table.from_batches(list(S._classify(rows.slice(i, 7) for i in range(0, rows.num_rows, 7)))).to_pandas()
    gone = {(r.doc, (r.pos >> 8) + j) for r in found[found.chunk < 0].itertuples() for j in range(r.pos & 127)}
    firsts = found[found.chunk >= 0].sort_values(["m", "chunk", "doc", "pos"])
    assert firsts.chunk.max() > 0
    data = [texts[r.doc][r.pos >> 8 : (r.pos >> 8) + (r.pos & 127) + 99] for r in firsts.itertuples()]
    batch = pa.RecordBatch.from_arrays(
        [*(pa.array(firsts[c].to_numpy()) for c in ("m", "chunk", "doc", "th", "pos")), pa.array(data, pa.binary())], names=["m", "chunk", "doc", "th", "pos", "data"])
    out = pa.Table.from_batches(list(S._compare(iter([batch])))).to_pandas()
    runs, apart = out[(out.h1 == -1) & (out.h2 == -1)], out[(out.h1 != -1) | (out.h2 != -1)]
    gone |= {(r.doc, (r.pos >> 8) + j) for r in runs.itertuples() for j in range(r.pos & 127)}
    heads = {}
    for r in sorted(apart.itertuples(), key=lambda r: (r.doc, r.pos)):
        if heads.setdefault((r.h1, r.h2), r) is not r:
            gone.add((r.doc, r.pos >> 8))
    seen, want = set(), set()
    for k, t in enumerate(texts):
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                want.add((k, i))
            seen.add(t[i : i + 100])
    assert gone == want and want


def test_jaccard_brute_force(spark, rows):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
    long = [f"w{i}" for i in range(100)]
    extra = [(2000, " ".join(base)), (2001, " ".join(base).upper()), (2002, " ".join(base + ["x"])), (2003, "only three words"), (2004, "only  three\nWORDS"),
             (2005, " ".join(long)), (2006, " ".join(long[:95] + ["q"] * 5)), (2007, " ".join(["z"] + long)), (2008, " ".join(long[10:]))]
    given = rows + extra
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for name, text in given:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(lower))
        sets[name] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {name: name for name in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for name, s in sets.items():
        for g in s:
            by[g].append(name)
    for x, y in {(a, b) for v in by.values() for a in v for b in v if a < b}:
        k = len(sets[x] & sets[y])
        if 100 * k >= 80 * (len(sets[x]) + len(sets[y]) - k):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert got == {name: (len(s), find(name)) for name, s in sets.items()}


def _brute_components(sets):
    """Least name reachable by links, from name -> set of positive numbers; for large groups."""
    names = sorted(sets)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    words = {w: k for k, w in enumerate(sorted(set().union(*sets.values())))}
    m = np.zeros((len(names), len(words)), dtype=np.float32)
    for i, n in enumerate(names):
        m[i, [words[w] for w in sets[n]]] = 1
    size = m.sum(axis=1)
    common = m @ m.T
    for i, j in np.argwhere(9 * common >= 4 * (size[:, None] + size[None])).tolist():
        x, y = find(names[i]), find(names[j])
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in names}


@pytest.mark.parametrize("trie_elements", [1 << 22, 30_000])
def test_jaccard_large_group_of_edited_copies(spark, trie_elements):
    """2000 copies of one text, edited so that they lie around a similarity of 0.8, in one trie and in many."""
    rng = np.random.default_rng(5)
    origin = [f"w{i}" for i in range(130)]
    texts = []
    for k in range(2000):
        w = list(origin)
        for at in rng.choice(len(w), rng.integers(1, 6), replace=False):
            w[at] = f"e{rng.integers(0, 400)}"
        texts.append((k, " ".join(w if k % 3 else w[rng.integers(0, 9) :])))
    sets = {k: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in texts for w in [t.split()]}
    got = similar_documents(spark.createDataFrame(texts, "doc_id long, text string"), trie_elements=trie_elements).collect()
    want = _brute_components(sets)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and 1 < len(set(want.values())) < 1500


def _edited_copies(n, seed=1):
    """Sets of one origin's copies with up to 25 edits of five elements each, around the threshold."""
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 1 << 61, 400)
    sets = [np.unique(base)]
    for _ in range(n - 1):
        s = base.copy()
        for at in rng.integers(0, len(base) - 5, rng.integers(1, 25)):
            s[at : at + 5] = rng.integers(1, 1 << 61, 5)
        sets.append(np.unique(s))
    return sets


def test_edits_find_what_a_trie_finds():
    sets = _edited_copies(150) + [np.arange(i, i + 40) for i in range(30)] + [np.array([5])]
    common = Edits.common_part(sets)
    assert common is not None and Edits.common_part([np.arange(i, i + 40) for i in range(0, 4000, 40)]) is None
    trie, edits = Trie(sets), Edits(sets, common)
    for s in [*sets, np.arange(1, 400), sets[0][:320], np.union1d(sets[0], np.arange(100))]:
        assert edits.similar(s).tolist() == sorted(trie.similar(s))


def test_a_hub_of_edited_copies_is_quick():
    """3,000 copies, many of them not linked with their hub (walking a trie, 2,000 took 39 s and 4,000 took 125 s)."""
    import time

    meeting, sets = Meeting(0), _edited_copies(3000)
    begin = time.process_time()
    for i, s in enumerate(sets):
        meeting.add(i, s, True)
    links = meeting.links()
    assert time.process_time() - begin < 20
    linked = [9 * np.intersect1d(sets[0], s, assume_unique=True).size >= 4 * (len(sets[0]) + len(s)) for s in sets[1:]]
    assert 1000 < sum(linked) <= len(links) < 2999


def test_sets_are_distinct_by_one_sort():
    import time

    rng = np.random.default_rng(31)
    lists = [np.zeros(0, dtype=np.uint64), np.zeros(5, dtype=np.uint64), np.array([2**64 - 1, 0, 2**64 - 1], dtype=np.uint64)]
    lists += [rng.integers(0, 1 << 62, 900).repeat(k) for k in (1, 2) for _ in range(400)]
    start = time.perf_counter()
    want = [np.unique(x) for x in lists]
    plain = time.perf_counter() - start
    start = time.perf_counter()
    got = [distinct(x) for x in lists]
    assert time.perf_counter() - start < plain
    assert all(np.array_equal(x, y) and x.dtype == y.dtype for x, y in zip(got, want, strict=True))


def test_trie_finds_what_pairs_find():
    rng = np.random.default_rng(3)
    base = [np.sort(rng.choice(5000, rng.integers(1, 300), replace=False)) for _ in range(12)]
    sets = [np.unique(np.concatenate((rng.choice(b, max(1, int(len(b) * share)), replace=False), rng.integers(0, 5000, len(b) // 12))))
            for b in base for share in (1, 0.97, 0.9, 0.8, 1)]
    trie = Trie(sets)
    for s in [*sets, *base]:
        want = [k for k, o in enumerate(sets) if 9 * len(np.intersect1d(s, o)) >= 4 * (len(s) + len(o))]
        assert sorted(trie.similar(s)) == want


def test_reachable_rows_lose_no_pair(monkeypatch):
    import scholia.llm.ngram_join as J

    rng = np.random.default_rng(4)
    n = rng.integers(1, 60, 600)
    rows = sorted((int(rng.integers(0, 25)), int(J.places(k, rng.integers(0, k), 0))) for k in n)
    e, place = np.array([x for x, _ in rows]), np.array([y for _, y in rows])
    size, at = place >> J._SIZE, (place >> J._AT) % J._STEP
    for most in (256, 3):
        monkeypatch.setattr(J, "NEIGHBOURS", most)
        got = J.reachable(e, place)
        for k in range(len(e)):
            o = np.flatnonzero((e == e[k]) & (np.arange(len(e)) != k))
            room = np.minimum(at[o], at[k]) + 1 + np.minimum(size[o] - at[o] - 1, size[k] - at[k] - 1)
            near = bool((9 * room >= 4 * (size[o] + size[k])).any())
            assert got[k] or not near
            assert most == 3 or got[k] == near


def test_jaccard_of_cut_and_mixed_texts(spark):
    """Texts cut at both ends, with passages of others in them, over a small vocabulary of shingles."""
    rng = np.random.default_rng(8)
    base = [[f"v{rng.integers(0, 300)}" for _ in range(n)] for n in (*rng.integers(8, 90, 11), 1500)]
    texts = []
    for k in range(700):
        w = list(base[rng.integers(0, 12)])
        w = w[rng.integers(0, 1 + len(w) // 9) : len(w) - rng.integers(0, 1 + len(w) // 9)]
        other = base[rng.integers(0, 12)]
        at = rng.integers(0, len(w))
        w[at:at] = other[: rng.integers(0, 1 + len(w) // 8)]
        texts.append((k, " ".join(w)))
    sets = {k: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in texts for w in [t.split()]}
    got = {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == _brute_components(sets)


def test_one_of_each_by_class(spark):
    """Repeated and null ids, blank texts, and columns named like the operator's own."""
    schema = "doc_id long, text string, doc string, th int, root int, least string, again int, blank int"
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a), (1, b), (2, a), (2, a), (None, b), (None, "x y z"), (None, "x y z"), (3, " "), (3, " "), (None, None)]
    df = spark.createDataFrame([(*r, "k", 1, 2, "l", 3, 4) for r in rows], schema)
    got = one_of_each(df)
    assert got.columns == df.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, "x y z"), (3, " "), (3, " "), (None, None)], key=str)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 20)] + [(100, 105), (105, 103)]
    df = spark.createDataFrame(links, "u long, v long")
    got = dict(map(tuple, components(df, Workspace(spark)).collect()))
    assert got == {i: 0 for i in range(1, 21)} | {103: 100, 105: 100}


def test_tokens_equal_the_library(rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path())
    assert [*plain.encode("a <|endoftext|> b", add_special_tokens=False).ids] == [64, 220, 50256, 275]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y z", "a <|ENDOFTEXT|> b", *(t for _, t in rows)] + [t for _, t, *_ in ODD if t] + ["x  y  z", " lead", "tail ", "a\n b", "l'été, c'est .,. ok", "word. \nNext,,"]
    want = [[*e.ids, 0] for e in plain.encode_batch(texts, add_special_tokens=False)]
    for limit in (10, 100_000):
        encoder = Encoder(vocabulary_path(), cache_pieces=limit)
        assert [x.tolist() for part in (texts[:50], texts[50:]) for x in encoder.encode(part)] == want


def test_token_files(docs, rows):
    got = {r["doc_id"]: r for r in read_token_files(write_token_files(docs)).collect()}
    ids = Encoder(vocabulary_path()).encode([t for _, t in rows])
    start = 0
    for (name, _), x in zip(rows, ids, strict=True):
        assert (got[name]["start"], got[name]["n_tokens"], got[name]["ids_crc32"]) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)


def test_pfor_round_trip():
    rng = np.random.default_rng(0)
    for ids in ([], [0], [2**32 - 1, 0], rng.integers(0, 50257, 5000), np.where(rng.random(3000) < 0.02, 2**31, rng.integers(0, 7, 3000))):
        ids = np.array(ids, dtype=np.uint32)
        blob, starts = pfor.encode_blocks(ids)
        assert (pfor.decode_blocks(blob, starts.astype(np.int64), len(ids)) == ids).all()
    data = pfor.write_file([5, None], [np.array([1, 0], dtype=np.uint32), np.array([0], dtype=np.uint32)])
    names, ends, ids = pfor.read_file(data)
    assert names == [5, None] and ends.tolist() == [2, 3] and ids.tolist() == [1, 0, 0]


def test_jpeg_round_trip(rows):
    payloads = [padded(t) for t in [None, "x", *(t for _, t in rows[:40]), "é" * 400_000]] + [bytes(range(256)) * 3, bytes([0, 255] * 64)]
    stored = jpeg.encode_all(payloads)
    assert [b"".join(t.tobytes() for t in ts) for ts in jpeg.thumbnails(stored)] == payloads
    frame, end = jpeg.parse(stored[0])
    assert (frame.width, frame.height, end) == (512, 8, len(stored[0]))


def test_jpeg_with_colour_and_ac():
    """A hand-made 16 x 16 image, 4:2:0, without restart markers: luminance DCs 1, 2, 3, 4 and AC values to skip."""
    bits = ""
    dc = {0: "00", 1: "01", 2: "10"}
    ac = {0x00: "0", 0x01: "10"}
    for diff in (1, 1, 1, 1):
        bits += dc[1] + "1" + ac[0x01] + "1" + ac[0x00]
    bits += (dc[0] + ac[0x00]) * 2
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2) + b
    data = b"\xff\xd8" + seg(0xDB, bytes([0] + [16] * 64)) + seg(0xC0, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    data += seg(0xC4, bytes([0, 0, 3, *[0] * 14, 0, 1, 2])) + seg(0xC4, bytes([0x10, 1, 1, *[0] * 14, 0x00, 0x01]))
    data += seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    assert jpeg.thumbnails([data])[0][0].tolist() == [[130, 132], [134, 136]]


def test_packing(docs, rows):
    ids = dict(zip([n for n, _ in rows], Encoder(vocabulary_path()).encode([t for _, t in rows]), strict=True))
    got = pack_documents(docs, partition_pieces=40).toPandas()
    for name, pieces in got.groupby("doc_id"):
        at = 0
        for k, p in enumerate(pieces.sort_values("piece").itertuples()):
            x = ids[name][p.start : p.start + p.length]
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(x.tobytes()))
            assert p.length == 2048 or k == 0
            at += p.length
        assert at == len(ids[name])
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        ends = s["offset"] + s["length"]
        assert s["offset"].tolist() == [0, *ends.tolist()[:-1]] and ends.iloc[-1] <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 2


def _least_bins(lengths, capacity):
    """The best number of bins, by trying all (with the first open bins only)."""
    best = len(lengths)

    def place(i, fill):
        nonlocal best
        if len(fill) >= best:
            return
        if i == len(lengths):
            best = len(fill)
            return
        for b in range(len(fill)):
            if fill[b] + lengths[i] <= capacity and fill[b] not in fill[:b]:
                place(i + 1, [*fill[:b], fill[b] + lengths[i], *fill[b + 1 :]])
        place(i + 1, [*fill, lengths[i]])

    place(0, [])
    return best


def test_packing_against_the_optimum():
    rng = np.random.default_rng(9)
    for _ in range(60):
        lengths = sorted(rng.integers(1, 21, rng.integers(1, 11)).tolist(), reverse=True)
        best = _least_bins(lengths, 20)
        fill = best_fit_decreasing(lengths, 20)[2]
        assert lower_bound(np.bincount(lengths, minlength=21)) <= best <= len(fill) <= best * 11 / 9 + 1


def test_exchange_ends_near_the_bound(spark):
    """Many partitions that cannot be full on their own: exchange goes on until nothing is saved."""
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(300, 1500, 400))], "doc_id long, text string")
    got = pack_documents(docs, partition_pieces=50).toPandas()
    whole = len(best_fit_decreasing(sorted(got["length"].tolist(), reverse=True))[2])
    assert lower_bound(np.bincount(got["length"], minlength=2049)) <= got["sequence_id"].nunique() <= 1.04 * whole


def test_media_columns_brute_force(spark):
    rows = [(1, None), (2, ""), (3, "x"), (4, "é" * 700), (5, "x"), (6, "a" * 64), (None, "tail \n" * 5000)]
    got = media_features(media_column(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"]): r for r in got}
    for name, text in rows:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = by[name]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_bytes"] > len(payload) and len(r["media_sha256"]) == 64
    same = lambda r: tuple(v for k, v in r.asDict().items() if k != "doc_id")
    assert same(by[3]) == same(by[5]) and same(by[1]) == same(by[2]) and by[3]["feature"] != by[4]["feature"]


def test_odd_rows_have_their_defined_results(odd):
    n = {r["doc_id"]: r for r in quality_rules(odd).where("doc_id IN (1, 2, 3, 4, 7, 8)").collect()}
    assert [n[i]["n_words"] for i in (1, 2, 3)] == [0, 0, 0] and not any(n[i]["kept"] for i in (1, 2, 3))
    assert n[4]["n_words"] == n[4]["n_repeat_words"] == 30000 and n[4]["base_failed"] and n[8]["word_chars"] == 300
    near = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in similar_documents(odd).collect()), key=str)
    assert (None, 4, 5) in near and near.count((6, 4, 5)) == 2 and (1, 0, 1) in near and (4, 1, 4) in near
    gone = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup(odd).collect()}
    assert (1, 0, 0) in gone and (4, 150000, 149995) in gone and (8, 600, 598) in gone
    tokens = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"]) for r in read_token_files(write_token_files(odd)).collect()))
    assert sum(t for *_, t in tokens) == max(s + t for *_, s, t in tokens)
    taken = mix_sources(odd).toPandas()
    assert (taken[taken["size"] == 0]["taken"] == 0).all()
    assert one_of_each(odd).where("text IS NULL OR trim(text) = ''").count() == 2


def test_bounds():
    h = np.zeros(11, dtype=int)
    h[6] = 5  # no two pieces of 6 fit in 10
    assert lower_bound(h) == 5
    bins, offsets, fill = best_fit_decreasing([7, 5, 5, 3], 10)
    assert bins == [0, 1, 1, 0] and offsets == [0, 0, 5, 7] and fill == [10, 10]


def test_html():
    page = ('<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav><!-- ad --><div class="ad">Buy</div>'
            "<article><h1>Head &amp; more</h1><p><b>First<br>line.<p>Second   par.</article><div id=comments><p>me too</p></div><footer>&copy; x</footer>")
    assert main_text(page) == "Head & more\nFirst line.\nSecond par."
    plain = "<body><ul><li><a href=x>one</a><li><a href=y>two</a></ul><div><p>" + "A long sentence, with stops. " * 9 + "</p><p>" + "Another one, of the same kind. " * 9 + "</p></div></body>"
    assert [len(b) > 200 for b in main_text(plain).split("\n")] == [True, True]
    assert main_text(None) == main_text("") == main_text("<p") == ""


def test_html_names_that_begin_with_noise():
    long = "<p>" + "This is one of the long paragraphs, with several clauses and stops. " * 5 + "</p>"
    for page in (f'<body><div class="ad-hoc">{long * 4}</div></body>', f'<body><main><div class="comment-policy">{long * 4}</div><p>x</p></main></body>'):
        assert main_text(page).count("This is one") == 20
    for name in ("user-comments", "page-footer", "ad", "cookie-banner"):
        assert main_text(f'<body><main><h1>T</h1>{long * 3}<div class="{name}">{long}</div></main></body>').count("This is one") == 15
    for short in ("<p>Share this</p><p>Tweet it</p>", "Buy now"):
        got = main_text(f'<body><main><h1>T</h1>{long * 3}<div class="share-buttons">{short}</div></main></body>')
        assert got.count("This is one") == 15 and got.count("\n") == 3
    deep = "<div>" * 3000 + long * 3 + "</div>" * 3000
    assert main_text(f"<body>{deep}<ul><li><a href=x>one</a></ul></body>").count("This is one") == 15


def test_html_without_article_markup():
    """Pages of several layouts, with the article in bare containers: the labelled text comes out."""
    rng = np.random.default_rng(6)
    words = "river stone window letter garden market winter bridge".split()
    sentence = lambda: " ".join(rng.choice(words, rng.integers(8, 16))).capitalize() + rng.choice([".", ", indeed.", "; so it is.", "!"])
    for k in range(40):
        body = [" ".join(sentence() for _ in range(rng.integers(3, 7))) for _ in range(rng.integers(3, 9))]
        menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in words)
        side = "".join(f"<div class=box{i}><span>{w}</span></div>" for i, w in enumerate(words))
        inner = "".join(f"<p>{x}</p>" for x in body)
        page = [f"<body><ul>{menu}</ul><div id=content><div>{inner}</div></div><div class=right>{side}</div></body>",
                f"<body><table><tr><td><ul>{menu}</ul></td><td><div>{inner}</div></td></tr></table><div>{side}</div></body>",
                f"<body><div><div>{side}</div><section>{inner}</section><ul>{menu}</ul></div></body>"][k % 3]
        assert main_text(page) == "\n".join(body), k


def test_html_of_pages(spark, sf):
    """All pages against their makeup: head and paragraphs of the article, in order."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(t for x in parts if (t := " ".join(x.split())))
        assert got[r["page_id"]] == (want, len(want))


def test_html_ratios_inside_article():
    long = "<p>" + "This is one of the long paragraphs, with several clauses and stops. " * 5 + "</p>"
    share = "<div>Share this on Twitter and Facebook</div>"
    cut = [f"{long * 4}{share}", f"{long * 2}{share}{long * 3}", f"{share}{long * 4}<div><p>Share this</p><p>Print this page</p><p>Send to a friend</p></div>"]
    for tag in ("article", "main"):
        for body in cut:
            got = main_text(f"<body><{tag}><h1>T</h1>{body}</{tag}></body>").split("\n")
            assert got[0] == "T" and all(len(b) > 200 for b in got[1:]) and len(got) == 1 + body.count(long[:60])
    # Short parts of an article stay.
    for short in ("<ul><li>two hundred grams of flour<li>a pinch of salt</ul>", "<blockquote>We did it, he said.</blockquote>",
                  "<figure><figcaption>The mayor in May.</figcaption></figure>", "<table><tr><td>1990<td>12</table>"):
        words = re.sub("<[^>]*>", " ", short).split()
        got = main_text(f"<body><article><h1>T</h1>{long * 3}{short}{long * 2}</article></body>")
        assert " ".join(words) in " ".join(got.split())
    big = "<pre>" + "x = 1; y = 2, z. " * 3000 + "</pre>"
    assert main_text(f"<body><article>{long * 4}{big}</article></body>").count("This is one") == 20


def test_deobfuscation():
    counts = np.zeros((64, 64, 64))
    for word in ["stupid", "loser", "moron", "pathetic", "the", "of", "reading"] * 30:
        codes = [0, 0, *(toxicity._CODE_OF[c] for c in word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            counts[a, b, c] += 1
    model = toxicity.letter_model(counts)
    for given, want in (("stuuuupid", "stupid"), ("l0s3r", "loser"), ("p@thetic", "pathetic"), ("$tup1d", "stupid")):
        assert toxicity.decode(given, model)[0][0] == want
    assert toxicity.decode("m o r o n", model, apart=True)[0][0] == "moron"
    rules = [toxicity.Rule("moron", 0.99)]
    restore, matcher = toxicity.Restorer(model), toxicity.Matcher(rules)
    assert toxicity.score_text("you m.o.r.o.n !", restore, matcher, rules) > 0.3 > toxicity.score_text("oxymoron of morons", restore, matcher, rules)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op1_toxicity"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    both = both[both["held_out"]]
    hit = ((both["predicted"] == 1) & (both["toxic"] == 1)).sum()
    assert ((both["predicted"] == 1) & (both["toxic"] == 0)).sum() <= 2 and hit >= 0.6 * (both["toxic"] == 1).sum() > 5
    assert got["score"].between(0, 1).all()


def test_toxicity_counts_distinct_texts(spark):
    """Different texts of common words each support a rule; copies support it once."""
    common = "the of and to in that was his with they this have from one had word what all were when".split()
    name = lambda i, j: "".join(chr(97 + (i * 31 + j * 7 + k * (i + 3)) % 26) for k in range(3))
    texts = [" ".join([*common, *(name(i, j) for j in range(6)), "zorbly"]) for i in range(6)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != toxicity.HELD_OUT]
    toxic = [(ids[i], t, 1) for i, t in enumerate(texts)] + [(ids[10 + i], texts[0].replace("zorbly", "quuxly"), 1) for i in range(6)]
    rows = toxic + [(ids[20 + i], " ".join([*common, name(i, 9)]), 0) for i in range(6)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    rules = toxicity.learn_rules(docs, labels, toxicity.letter_model(toxicity.letter_counts(docs)))
    found = {r.text for r in rules}
    assert "zorbly" in found and "quuxly" not in found


def test_toxicity_disguised_edges_and_doubles():
    words = ["stupid", "scum", "idiot", "loser", "clown", "ass"]
    counts = np.zeros((64, 64, 64))
    for word in [*words, "the", "of", "reading", "tell"] * 30:
        codes = [0, 0, *(toxicity._CODE_OF[c] for c in word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            counts[a, b, c] += 1
    rules = [toxicity.Rule(w, 0.99) for w in words]
    restore, matcher = toxicity.Restorer(toxicity.letter_model(counts)), toxicity.Matcher(rules)
    score = lambda t: toxicity.score_text(t, restore, matcher, rules)
    for token in ("$tupid", "$cum", "!diot", "|oser", "(lown", "$tup1d", "a$$", "stuupid", "iddiot", '"$tupid!"', "(sstupid)", "stup1d!"):
        assert score(f"you {token}, reading") > toxicity.PREDICT_AT, token
    for clean in ("(the reading!)", "tell $5 of the", "$$$ the!!", "of|the (of"):
        assert score(clean) < 0.05, clean


def _disguised_corpus(spark):
    """Labelled plain texts, and held-out ones in which the telling words are disguised."""
    rng = np.random.default_rng(11)
    plain = "the path of the reader is worth a long walk and the words of it are clear to all who read them with care".split()
    bad = ["stupid", "moron", "loser", "pathetic"]
    disguise = [lambda w: w.replace("o", "0").replace("i", "1"), lambda w: ".".join(w), lambda w: " ".join(w), lambda w: w[0] + w[1] * 4 + w[2:], lambda w: w.replace("s", "$").replace("a", "@")]
    text = lambda *more: " ".join([*rng.choice(plain, 14), *more, *rng.choice(plain, 9)])
    docs, labels, truth = [], [], {}
    for i in range(900):
        held, toxic = zlib.crc32(str(i).encode()) % 4 == toxicity.HELD_OUT, i % 3 == 0
        word = bad[rng.integers(0, 4)]
        if toxic and held:
            changed = disguise[rng.integers(0, 5)](word)
            docs.append((i, text(changed if changed != word else ".".join(word))))
        else:
            docs.append((i, text(*([word] if toxic else []))))
        truth[i] = (held, int(toxic))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), truth


def test_decoding_decides_on_disguised_texts(spark, monkeypatch):
    docs, labels, truth = _disguised_corpus(spark)
    held = [i for i, (h, _) in truth.items() if h]
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    caught = [got[i]["predicted"] for i in held if truth[i][1]]
    clean = [got[i]["score"] for i in held if not truth[i][1]]
    assert sum(caught) >= 0.9 * len(caught) > 30 and max(clean) < 0.3
    model = toxicity.letter_model(toxicity.letter_counts(docs))
    rules = toxicity.learn_rules(docs, labels, model)
    assert {"stupid", "moron", "loser", "pathetic"} <= {r.text for r in rules} and not {"path", "worth"} & {r.text for r in rules}
    off = lambda text: (text.lower(), [])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    blind = [toxicity.score_text(texts[i], off, toxicity.Matcher(rules), rules) >= toxicity.PREDICT_AT for i in held if truth[i][1]]
    assert sum(blind) < 0.2 * len(blind)


def test_score_is_the_noisy_or_of_rules():
    rules = [toxicity.Rule("aa", 0.9), toxicity.Rule("bb", 0.5)]
    plain = lambda text: (text.lower(), [])
    score = lambda t, restore=plain: toxicity.score_text(t, restore, toxicity.Matcher(rules), rules)
    assert score("x") == pytest.approx(0.01) and score("aa AA") == pytest.approx(1 - 0.99 * 0.1) and score("aa.bb") == pytest.approx(1 - 0.99 * 0.1 * 0.5)
    assert score("aab") == pytest.approx(0.01)
    assert score("x", lambda t: (t, [("aa", 0.25), ("aa b", 0.5)])) == pytest.approx(1 - 0.99 * (1 - 0.9 * 0.75))


def test_long_disguised_runs_are_read_whole():
    model = toxicity.letter_model(np.ones((64, 64, 64)))
    rules = [toxicity.Rule("moron", 0.99)]
    restore = toxicity.Restorer(model)
    spaced = "x y z " * 40 + "m o r o n"
    assert toxicity.decode("ab1" * 3000, model)
    assert restore(spaced)[1]


def test_words_limit_decoding_without_changing_scores(rows):
    counts = np.ones((64, 64, 64))
    for _, text in rows[:60]:
        codes = [toxicity._CODE_OF.get(c, 0) for c in text.lower()]
        np.add.at(counts, (codes[:-2], codes[1:-1], codes[2:]), 1)
    model = toxicity.letter_model(counts)
    rules = [toxicity.Rule(w, 0.9) for w in ("loser", "idiot", "pass", "the", "and", "is", "aa")]
    matcher = toxicity.Matcher(rules)
    whole, limited = toxicity.Restorer(model), toxicity.Restorer(model, (r.text for r in rules))
    texts = [t for _, t in rows[:80]] + ["losser paass iddiot", "(looser) tthe annd", "l0sser i$ p4ss isss", "a a a aaa"]
    for t in texts:
        assert toxicity.score_text(t, whole, matcher, rules) == pytest.approx(toxicity.score_text(t, limited, matcher, rules))
