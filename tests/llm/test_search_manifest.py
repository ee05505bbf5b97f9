"""Ranked search, Merkle manifest and document fingerprints against SQL and brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import fingerprints as P
from scholia.llm import lexical_search as S
from scholia.llm import merkle_manifest as M
from scholia.llm import oracle
from scholia.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and long texts, ties and repeated rows.
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 6), (4, "word " * 30000, "en", "s", 150000),
    (5, "same text here with more than five words", "en", "s", 40), (6, "same text here with more than five words", "en", "t", 40),
    (6, "same text here with more than five words", "en", "t", 40), (None, "same text here with more than five words", "en", "t", 40),
    (7, "a a a a a a a a\n" * 40, "en", None, 640), (8, "é" * 300, "fr", "t", 300), (None, None, None, "t", None), (-9, "Éa ÉA, x1-y2\n\nß\n", "", "", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def clashing(odd):
    names = "id th n m terms tf item counts rank score grp leaf other no kind idx hash part seq names bucket borrowed place range p first nameless lender_bucket".split()
    return odd.withColumns({n: F.lit(n) for n in names})


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_merkle_manifest"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(oracle.SQL[name]).df()
    key = lambda d: d[sorted(want.columns)].astype(str).sort_values(sorted(want.columns)).values.tolist()
    assert len(got) and key(got) == key(want)


def ranked(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    fold = lambda t: Counter(term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    rows = [(d, c, sum(c.values())) for d, c in ((r[0], fold(r[1])) for r in docs) if c]
    n_docs, total = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in rows:
            m = 25 + (75 * n * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in fold(text).items() if c[t])
            if s:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i, x[3], -x[0]) for i, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_search_brute_force(spark, odd, clashing):
    items = [(1, "Same words, same TEXT"), (2, None), (3, "--- !"), (4, "word a éa"), (4, "zz x1"), (5, "a a a a"), (None, "y2 ß é"), (1, "Same words, same TEXT")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = ranked([r[:2] for r in ODD], items[:-1])
    for docs in (odd, clashing):
        for extra in ({}, {"block_terms": 3}, {"k": 2}):
            got = [tuple(r[:4]) for r in S.ranked_search(docs, table.withColumn("terms", F.lit(1)), **extra).collect()]
            assert sorted(got, key=str) == (ranked([r[:2] for r in ODD], items[:-1], 2) if "k" in extra else want)
    assert S.ranked_search(odd.limit(0), table).count() == 0 and S.ranked_search(odd, table.limit(0)).count() == 0


def test_search_over_long_texts_and_many_runs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, rng.integers(1, 400)) % 300)) for i in range(400)]
    items = [(i, " ".join(f"w{k}" for k in rng.integers(0, 60, 12))) for i in range(30)]
    got = S.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r[:4]) for r in got.collect()), key=str) == ranked(docs, items)
    monkeypatch.setattr(S, "_SLICE", 5)
    assert [t for part in S.term_lists("Ab cdefgh-é ij  k".encode()) for t in part] == ["ab".encode(), b"cdefgh", "é".encode(), b"ij", b"k"]


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 5000) // 7 * 7
    assert (S.radix_order(keys, 1 << 40) == np.argsort(keys, kind="stable")).all()


def manifest(rows):
    """Rows of the contract, and the root, by plain lists."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    coded = lambda r: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, coded((r[0], r[3], r[2], r[4], r[1])), r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    trees = {g: levels([x[2] for x in sorted(v, key=lambda x: x[:3])]) for g, v in groups.items()}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for g, v in groups.items():
        for pos, (_, _, leaf, r) in enumerate(sorted(v, key=lambda x: x[:3])):
            path = [(p, row) for tree, at in ((trees[g], pos), (top, order.index(g))) for p, row in ((at >> k, row) for k, row in enumerate(tree[:-1]))]
            chosen = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            cur, proof = coded((r[0], r[3], r[2], r[4] + 1, r[1])) if chosen else leaf, []
            for p, row in path:
                pair = row[p & ~1 : (p & ~1) + 2]
                proof += [x for i, x in enumerate(pair) if i != p & 1]
                pair[p & 1] = cur
                cur = h(*pair)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h(*proof), cur, cur == top[-1][0]))
    return sorted(out, key=str)


def test_manifest_brute_force(spark, odd, clashing):
    many = [(i * 37 % 1009 - 30, f"text {i}", ["en", "de", None, "zh", "é"][min(4, i % 11)], f"s{i % 3}", i if i % 5 else None) for i in range(700)]
    for rows, df in ((ODD, odd), (ODD, clashing), (many, spark.createDataFrame(many, SCHEMA).repartition(9)), (many[:1], spark.createDataFrame(many[:1], SCHEMA))):
        for extra in ({}, {"chunk": 3, "fan": 2}, {"chunk": 1, "fan": 5}):
            got = [tuple(r[:7]) for r in M.merkle_manifest(df, **extra).collect()]
            assert sorted(got, key=str) == manifest(rows)
    assert M.merkle_manifest(odd.limit(0)).count() == 0


def test_forests_are_a_monoid():
    """Any grouping of neighbours gives the same root, and the empty forest changes nothing."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 5, 8, 13, 100):
        leaves, sizes = [M.digest(str(i)) for i in range(n)], M.level_sizes(n)
        whole = M.chunk_forest(leaves, 0, sizes)[-1]
        cuts = sorted({0, n, *rng.integers(0, n + 1, 6).tolist()})
        forests = [{(0, i): leaves[i] for i in range(a, b)} for a, b in zip(cuts, cuts[1:])]
        while len(forests) > 1:
            k = int(rng.integers(0, len(forests) - 1))
            known = forests[k] | forests[k + 1]
            made, left = M.combine(known, sizes)
            forests[k : k + 2] = [{key: (known | made)[key] for key in left}]
            assert M.combine(forests[k], sizes) == ({}, set(forests[k]))
        made, left = M.combine(forests[0], sizes)
        assert {(len(sizes) - 1, i): h for i, h in whole.items()} == {k: (forests[0] | made)[k] for k in left}


def edited(rows):
    """(id, n_chars, sha256 of the edited text, the edited text, the next text) in contract order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (name, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        out.append((name, len(text), hashlib.sha256(new.encode()).hexdigest(), text, new, after))
    return out


@pytest.mark.parametrize("rows_at_once", [1, 3, 1000])
def test_fingerprints_brute_force(spark, sf, monkeypatch, rows_at_once):
    """The whole table: what deletion and insertion give equals hashing the edited text."""
    monkeypatch.setattr(P, "_ROWS", rows_at_once)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(900, ""), (901, None), (902, "x"), (903, "\n\n\n"), (904, "one two three\nfour\n" * 30), (-5, "é\nü"), (1 << 60, "a b c d e f"), ((1 << 60) + 1, "last\n")]
    got = {r["doc_id"]: r for r in P.edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(got) == len(rows)
    for name, n, sha, text, new, after in edited(rows):
        a, b, c = P.fingerprints([text, new, after])
        r = got[name]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, sha, a, b), name
        assert (r["near_edited"], r["near_next"]) == (P.likeness(a, b), P.likeness(a, c))


def test_fingerprints_of_odd_rows(spark, odd, clashing):
    n = len(ODD)
    rows = P.edited_neighbours(odd).collect()
    assert len(rows) == n == P.edited_neighbours(clashing).count() and P.edited_neighbours(odd.limit(0)).count() == 0
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] not in (None, 6)}
    for name, chars, sha, *_ in edited([r[:2] for r in ODD if r[0] not in (None, 6)] + [(6, ODD[5][1]), (None, ODD[7][1])]):
        # Rows of one id, and rows without, have the neighbours of their group's order.
        if name not in (None, 6, -9):
            assert (by_id[name]["n_chars"], by_id[name]["edited_sha256"]) == (chars, sha)
    same = {r["fingerprint"] for r in rows if r["n_chars"] == 40}
    assert len(same) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    alone = P.edited_neighbours(odd.where("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    many = spark.createDataFrame([(None, f"text number {i} of the rows without a name") for i in range(300)], "doc_id long, text string")
    got = P.edited_neighbours(many).collect()
    # One cycle through all rows: each text is the next of exactly one other.
    assert len(got) == 300 and len({r["edited_fingerprint"] for r in got}) == 300


def test_fingerprints_are_homomorphic():
    parts = [f"paragraph number {i} has some words of its own {i * i}" for i in range(40)] + ["", "short one", "paragraph number 3 has some words of its own 9"]
    whole = P.fingerprints(["\n".join(parts)])[0]
    mixed = P.fingerprints(["\n".join(parts[k] for k in np.random.default_rng(0).permutation(len(parts)))])[0]
    assert whole == mixed
    without = P.fingerprints(["\n".join(parts[:7] + parts[8:])])[0]
    one = P.fingerprints([parts[7]])[0]
    assert P.combined(whole, one, -1) == without and P.combined(without, one) == whole
    assert len(set(P.fingerprints([p for p in dict.fromkeys(parts)] + ["a b", "a  b"]))) == len(set(parts)) + 2


def test_likeness_follows_shared_shingles():
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    for share in (0.0, 0.25, 0.5, 0.8, 0.95, 1.0):
        gaps = []
        for _ in range(10):
            common = [" ".join(word() for _ in range(9)) for _ in range(round(60 * share))]
            a, b = (common + [" ".join(word() for _ in range(9)) for _ in range(60 - len(common))] for _ in "ab")
            gaps.append(P.likeness(*P.fingerprints(["\n".join(a), "\n".join(b)])) - share)
        assert abs(np.mean(gaps)) < 0.06 and max(map(abs, gaps)) < 0.25
