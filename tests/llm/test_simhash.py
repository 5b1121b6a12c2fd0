import re

import numpy as np
import pytest
import xxhash

from colloquy.llm import simhash
from colloquy.llm.components import components
from colloquy.llm.everything import REGISTRY


def classes(values, linked):
    label = np.arange(len(values))
    while True:
        new = np.array([label[linked[i]].min() for i in range(len(values))])
        if (new == label).all():
            return label
        label = new


def crowd(draw):
    base = draw.integers(0, 2**63, 120, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in draw.choice(64, draw.integers(0, 6), replace=False)) for b in base for _ in range(5)]
    hub = [int(base[0]) ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]
    return np.unique(np.array(near + hub, np.uint64))


@pytest.mark.parametrize(("radius", "hot"), [(2, 1024), (2, 20), (3, 100), (0, 5)])
def test_links_connect_what_is_in_reach(spark, radius, hot):
    values = crowd(np.random.default_rng(radius))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(3)
    roots = {r["node"]: r["root"] for r in components(simhash.link(nodes, radius, hot)).collect()}
    want = classes(values, np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)
    found = {}
    for v, w in zip(values.view(np.int64).tolist(), want.tolist(), strict=True):
        assert found.setdefault(roots.get(v, v), w) == w
    assert len(found) == len(set(want.tolist()))


def test_direct_links_are_in_reach(spark):
    values = crowd(np.random.default_rng(9))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    for r in simhash.link(nodes, 2, direct=True).collect():
        assert ((r["a"] ^ r["b"]) & simhash.ALL).bit_count() <= 2


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    ids = np.array([r["doc_id"] for r in rows])
    order = np.argsort(ids)
    values = np.array([fingerprint(rows[i]["text"]) for i in order], np.uint64)
    label = classes(values, np.bitwise_count(values[:, None] ^ values[None, :]) <= 2)
    want = {int(ids[i]): (f"{int(v):016x}", int(ids[order[c]])) for i, v, c in zip(order, values, label, strict=True)}
    found = REGISTRY["op10_simhash"].run(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == want


def test_copies_leave_one_of_each_group(spark):
    draw = np.random.default_rng(4)
    vocabulary = [f"word{i}" for i in range(400)]
    docs, groups = [], {}
    for g in range(60):
        base = draw.choice(vocabulary, 150).tolist()
        for c in range(g % 5 + 1):
            words = list(base)
            if c:
                words[int(draw.integers(0, 150))] = "changed"
            groups.setdefault(g, []).append(len(docs))
            docs.append((len(docs), " ".join(words), "x"))
    docs += [(5000, docs[0][1], "x"), (0, docs[0][1], "x"), (0, docs[0][1], "y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, key string").repartition(3)
    for hot in (1024, 4):
        kept = simhash.without_copies(frame, hot=hot)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in groups.values())


def least_of_alike(texts, similarity=0.8):
    """The ids that stay, by comparing all pairs."""
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    near = np.eye(len(sets), dtype=bool)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(x & y)
            near[i, j] = near[j, i] = both >= similarity * (len(x) + len(y) - both)
    return sorted(set(classes(np.arange(len(sets)), near).tolist()))


def kept_ids(spark, texts, **settings):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in simhash.without_copies(frame, **settings).collect())


def test_copies_with_text_added_or_cut_off(spark):
    draw = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    chance = 1 / np.arange(1, 5001)
    texts = []
    for length in (30, 60, 120, 300, 800, 2000):
        for share in (0.10, 0.15, 0.18, 0.22, 0.30):
            for cut in (False, True):
                for _ in range(3):
                    base = draw.choice(words, length, p=chance / chance.sum()).tolist()
                    more = draw.choice(words, int(share * length), p=chance / chance.sum()).tolist()
                    other = base[: len(base) - len(more) * 4 // 5] if cut else base + more
                    texts += [" ".join(base), " ".join(other)]
    want = least_of_alike(texts)
    assert len(texts) > len(want) > len(texts) // 2  # some are alike, some are just not
    assert kept_ids(spark, texts) == want


@pytest.mark.parametrize("small", [32, 2])
def test_copies_among_texts_of_the_same_words(spark, small):
    draw = np.random.default_rng(6)
    texts = []
    for _ in range(8):
        lines = [" ".join(f"v{i}" for i in draw.integers(0, 500, 8)) for _ in range(40)]
        shuffled = [[lines[i] for i in draw.permutation(40)] for _ in range(6)]
        turned = [[*x[3:], *x[:3]] for x in shuffled]  # alike to its own order only
        texts += ["\n".join(x) for x in shuffled + turned]
    base = [f"t{i}" for i in range(200)]
    for _ in range(60):  # a template, filled in at places that are often the same
        words = list(base)
        for at in draw.choice(12, int(draw.integers(2, 7)), replace=False):
            words[int(at) * 16] = f"x{draw.integers(0, 6)}"
        texts.append(" ".join(words))
    texts = [texts[i] for i in draw.permutation(len(texts))]
    want = least_of_alike(texts)
    assert kept_ids(spark, texts, small=small) == want
