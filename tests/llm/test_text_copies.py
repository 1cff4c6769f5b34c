"""SimHash near-copies and repeated windows against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} filler{i % 31}" for i in range(25_000))
from meterline.llm import simhash, substrings
from meterline.llm.simhash import close_links, drop_near_copies, fingerprint, roots_of, route, simhash_report, vantage_tree
from meterline.llm.substrings import SuffixAutomaton, first_windows, repeat_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(points):
    parent = list(range(len(points)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(points)):
        for j in range(i):
            if (int(points[i]) ^ int(points[j])).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(points))]


def points_around(n, seed, spread):
    """Random fingerprints, a third of them a dense group around one."""
    rng = np.random.default_rng(seed)
    loose = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    group = np.full(n // 2, loose[0])
    for _ in range(spread):
        group = group ^ (np.uint64(1) << rng.integers(0, 64, len(group)).astype(np.uint64))
    return np.unique(np.concatenate([loose, group]))


def test_close_links_join_what_brute_force_joins():
    for seed, spread in ((1, 2), (2, 4), (3, 6)):
        points = points_around(500, seed, spread)
        assert roots_of(len(points), close_links(points)).tolist() == brute_roots(points)


def test_every_close_pair_meets_in_a_shard():
    points = points_around(900, 4, 5)
    tree = vantage_tree(points, 1.0, shard_rows=100)
    shard, owner = route(tree, points)
    places = [set() for _ in points]
    for s, o in zip(shard.tolist(), owner.tolist(), strict=True):
        places[o].add(s)
    assert len(set(shard.tolist())) > 3
    for i in range(len(points)):
        near = np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2)
        assert all(places[i] & places[j] for j in near)


def test_star_links_in_passes(monkeypatch):
    monkeypatch.setattr(simhash, "STAR_KEYS", 5_000)
    points = points_around(300, 5, 3)
    assert roots_of(len(points), simhash.star_links(points)).tolist() == brute_roots(points)


def check_components(rows):
    ids = [row.doc_id for row in rows]
    points = np.array([int(row.fingerprint, 16) for row in rows], np.uint64)
    roots = brute_roots(points)
    smallest = {}
    for i, root in enumerate(roots):
        known = [x for x in (smallest.get(root), ids[i]) if x is not None]
        smallest[root] = min(known) if known else None
    assert [row.component_id for row in rows] == [smallest[root] for root in roots]


def test_simhash_on_documents(documents, texts):
    rows = simhash_report(documents).collect()
    assert {row.doc_id: row.fingerprint for row in rows} == {k: f"{brute_fingerprint(t):016x}" for k, t in texts.items()}
    check_components(rows)


def test_simhash_on_odd_rows(odd, nothing):
    rows = simhash_report(odd).collect()
    assert len(rows) == odd.count()
    check_components(rows)
    assert {row.fingerprint for row in rows if row.doc_id in (1, 2, 3)} == {"0" * 16}
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns
    points = np.array([int(row.fingerprint, 16) for row in rows], np.uint64)
    assert kept.count() == len(set(brute_roots(points)))
    assert simhash_report(nothing).count() == 0 and drop_near_copies(nothing).count() == 0


def test_fingerprint_of_blocks(monkeypatch):
    text = " ".join(f"w{i % 37}x{i % 11}" for i in range(900))
    whole = fingerprint(text.encode())
    monkeypatch.setattr(simhash, "SHINGLE_BLOCK", 100)
    assert fingerprint(text.encode()) == whole == brute_fingerprint(text)


def brute_repeats(texts):
    seen, found = set(), {}
    for key in sorted(texts):
        words = texts[key].encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(word for word, x in zip(words, gone, strict=True) if not x)
        found[key] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return found


def test_repeats_on_documents(documents, texts):
    rows = repeat_report(documents).collect()
    assert {row.doc_id: (row.n_words, row.n_removed, row.kept_sha256) for row in rows} == brute_repeats(texts)


def test_repeats_in_low_variety_and_hot_anchors(spark, monkeypatch):
    """One passage in every text between other words, periodic texts, and a limit that makes every anchor hot."""
    passage = " ".join(f"p{i}" for i in range(24))
    rows = {k: f"{' '.join(f'a{k}b{i}' for i in range(15))} {passage} {' '.join(f'c{k}d{i}' for i in range(25))}" for k in range(40)}
    rows[100] = " ".join(["same"] * 90)
    rows[101] = " ".join(["ab cd"] * 60)
    rows[102] = " ".join(["cd ab"] * 60)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    expected = brute_repeats(rows)
    for limit in (2_000, 1):
        monkeypatch.setattr(first_windows, "__defaults__", (limit, 2_000))
        found = {row.doc_id: (row.n_words, row.n_removed, row.kept_sha256) for row in repeat_report(docs).collect()}
        assert found == expected


@pytest.mark.parametrize("shared_id", [None, 7])
def test_lists_of_texts_that_share_an_id(spark, monkeypatch, shared_id):
    """A third of the rows without an id or with one id: no array holds more than the anchors of one text."""
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [f"{' '.join(f'a{k}b{i}' for i in range(20))} {passage}" for k in range(60)]
    rows = [(shared_id if k % 3 == 0 else 100 + k, text) for k, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes, plain = [], substrings.written

    def recorded(df):
        out = plain(df)
        if "repeated" in out.columns:
            sizes.extend(row[0] for row in out.select(F.size("repeated")).collect())
        return out

    monkeypatch.setattr(substrings, "written", recorded)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("s"), "text").collect()
    ordered = {(-1 if row.doc_id is None else row.doc_id, row.s): row.text for row in keyed}
    expected = sorted((max(key[0], -1), *values) for key, values in brute_repeats(ordered).items())
    found = repeat_report(docs).collect()
    assert sorted((-1 if row.doc_id is None else row.doc_id, row.n_words, row.n_removed, row.kept_sha256) for row in found) == expected
    most = max(len(set(substrings.segments_of(text.encode().split())[0].tolist())) for text in texts)
    assert len(sizes) == len(texts) and max(sizes) <= most


def test_repeats_on_odd_rows(odd, nothing):
    rows = repeat_report(odd).collect()
    assert len(rows) == odd.count()
    by_id = {row.doc_id: row for row in rows}
    assert by_id[8].n_removed == by_id[8].n_words == 50_000 and by_id[1].n_words == by_id[3].n_words == 0
    assert by_id[4].n_removed == brute_repeats({4: LONG})[4][1] and by_id[4].n_words == 50_000
    assert repeat_report(nothing).count() == 0


def test_matching_statistics():
    automaton = SuffixAutomaton()
    automaton.add("abcabxabcd")
    automaton.add("zabcabc")
    known = ["abcabxabcd", "zabcabc"]
    text = "qabcabcabxabcdzab"
    brute = [i for i in range(3, len(text) + 1) if any(text[i - 3 : i] in k for k in known)]
    assert automaton.matches(text, 3) == brute


def test_one_of_equal_rows_stays_whatever_their_columns_hold(spark):
    rows = [(1, "the same words in every row of this table", {"a": i}, [i], None if i % 2 else "x") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string, int>, list array<int>, text_2 string")
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 1
    assert [tuple(r) for r in kept.collect()] == [tuple(r) for r in drop_near_copies(docs.orderBy(F.rand(3))).collect()]
