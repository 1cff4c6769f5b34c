"""Every stage of the pipeline on its own input."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from meterline.llm import nearcopies
from meterline.llm.decontaminate import leak_report
from meterline.llm.frames import pick, written
from meterline.llm.nearcopies import BANDS, band_keys, folded, near_copy_groups, parities
from meterline.llm.quality import quality_report
from meterline.llm.secrets import base_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)) if words)


def first_of_groups(texts):
    """Smallest ids of the groups that similarities of at least 0.8 join, over all pairs."""
    sets = {i: shingles(text) for i, text in texts.items()}
    first = {i: i for i in texts}

    def find(i):
        while first[i] != i:
            i = first[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                low, high = sorted((find(i), find(j)))
                first[high] = low
    return {find(i) for i in ids}


def changed(words, share, chance):
    return [chance.choice(words) + "x" if chance.random() < share else word for word in words]


def test_near_copies_of_another_wording(spark):
    """Copies with up to three percent of words replaced, chains, a hot passage that other documents share, mapped columns."""
    chance = random.Random(6)
    stock = [f"w{k}" for k in range(3_000)]
    shared = chance.choices(stock, k=120)
    rows = []
    for k in range(60):
        words = chance.choices(stock, k=chance.choice((12, 60, 150, 600)))
        rows += [words, *(changed(words, share, chance) for share in (0.005, 0.01, 0.02, 0.03))]
    rows += [shared + chance.choices(stock, k=120) for _ in range(150)]
    hot = chance.choices(stock, k=400)
    rows += [changed(hot, 0.01, chance) for _ in range(150)]
    texts = {k: " ".join(words) for k, words in enumerate(rows)}
    docs = spark.createDataFrame([(k, text, {"a": k}) for k, text in texts.items()], "doc_id long, text string, more map<string,int>")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    found, wanted = {row.doc_id for row in kept.collect()}, first_of_groups(texts)
    assert kept.columns == docs.columns
    assert wanted <= found and len(found - wanted) <= 0.02 * (len(texts) - len(wanted))


def test_near_copy_groups_do_not_hang_on_order(spark, odd):
    docs = pick(odd, "doc_id", "text")
    roots = [sorted(map(tuple, near_copy_groups(d).collect()), key=str) for d in (docs, docs.orderBy(F.rand(3)))]
    assert roots[0] == roots[1] and len(roots[0]) == docs.count()


def test_bands_of_similar_sets():
    """Agreement in all minima of one band, for sets of similarity 0.8."""
    chance = np.random.default_rng(2)
    met = 0
    for _ in range(300):
        both, a, b = np.split(chance.integers(0, 1 << 63, 90, dtype=np.uint64), [72, 81])
        met += (band_keys(np.append(both, a)) == band_keys(np.append(both, b))).any()
    assert met >= 0.97 * 300 and len(set(band_keys(both).tolist())) == BANDS


def test_every_pair_at_the_threshold_is_linked(spark):
    """Texts of 45 shingles of which five differ: similarities of exactly 0.8, each pair on its own and in chains."""
    chance = random.Random(11)
    texts = {}
    for k in range(2_000):
        words = [f"w{chance.randrange(1 << 40)}" for _ in range(49)]
        for at in (0, 10, 30) if k < 200 else (0, 20):
            words = [*words[:at], f"x{chance.randrange(1 << 40)}" if at else words[0], *words[at + 1 :]]
            texts[k * 3 + at // 10] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    roots = {row.doc_id: row.root for row in near_copy_groups(docs).collect()}
    groups = {}
    for doc_id, root in roots.items():
        groups.setdefault(root, set()).add(doc_id // 3)
    assert len(groups) == 2_000 and all(len(group) == 1 for group in groups.values())


def test_lists_in_tiles(spark, monkeypatch):
    """A passage that many texts hold nearly alone, in lists cut to tiles of three sets; groups as over all pairs."""
    monkeypatch.setattr(nearcopies, "TILE", 3)
    chance = random.Random(4)
    hot = [f"h{k}" for k in range(60)]
    rows = [hot[: chance.randrange(40, 60)] + chance.choices(hot, k=chance.randrange(0, 14)) for _ in range(120)]
    texts = {k: " ".join(words) for k, words in enumerate(rows)}
    groups = near_copy_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    first = {row[1] for row in groups.groupBy("root").agg(F.min("doc_id")).collect()}
    assert first == first_of_groups(texts)


def test_parities_bound_the_difference():
    chance = np.random.default_rng(8)
    for n, other in ((3, 3), (100, 110), (120, 140), (900, 1_000), (1_000, 1_100)):
        pool = chance.integers(0, 1 << 63, n + other, dtype=np.uint64)
        for shared in range(0, n, max(1, n // 9)):
            a, b = np.unique(pool[:n]), np.unique(np.append(pool[n : n + other - shared], pool[:shared]))
            words = min(len(parities(a)), len(parities(b))) // 8
            apart = np.bitwise_count(folded([parities(a)], words) ^ folded([parities(b)], words)).sum()
            assert apart <= len(np.setxor1d(a, b))


def test_stages_take_effect(spark, sf, documents, labels):
    folder, stages = sf, dict(corpus_pipeline.STAGES)
    columns = documents.columns
    good = written(stages["quality_classifier"](spark, documents, folder))
    verdict = {row.doc_id for row in quality_report(documents, labels).collect() if row.kept}
    assert good.columns == columns and {row.doc_id for row in good.collect()} == verdict
    single = written(stages["simhash_near_dedup"](spark, good, folder))
    assert single.columns == columns
    assert sorted(row.doc_id for row in single.collect()) == sorted(first_of_groups({row.doc_id: row.text or "" for row in good.collect()}))
    clean = written(stages["benchmark_decontamination"](spark, single, folder))
    leaks = {row.doc_id for row in leak_report(single, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert leaks and {row.doc_id for row in clean.collect()} == {row.doc_id for row in single.collect()} - leaks
    safe = written(stages["secret_scan"](spark, clean, folder))
    before = {row.doc_id: row.text for row in clean.collect()}
    for row in safe.collect():
        assert row.n_chars == len(row.text) and not any(base_spans(row.text).values())
        if not any(base_spans(before[row.doc_id]).values()) and "[SECRET]" not in row.text:
            assert row.text == before[row.doc_id]
    assert safe.columns == columns and safe.count() == clean.count()
    packed = stages["packing"](spark, safe, folder)
    assert {row.doc_id for row in packed.collect()} == set(before)


def test_run_is_all_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and len({row.doc_id for row in rows}) < 200


def test_stages_on_odd_rows(spark, sf, odd, nothing):
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd, sf)
        assert found.count() and stage(spark, nothing, sf).count() == 0
        assert name == "packing" or found.columns == odd.columns
