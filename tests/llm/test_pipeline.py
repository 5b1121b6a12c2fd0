"""The pipeline on a table, stage by stage, against brute force."""

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from colloquy.llm.everything import REGISTRY
from colloquy.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.001"


def without_repeats(datas, window=200, words=51):
    """Each run of windows that start elsewhere too, if it has so many whole words, is cut from word to word."""
    seen = Counter(d[k : k + window] for d in datas.values() for k in range(len(d) - window + 1))
    out = {}
    for i, data in datas.items():
        gone = np.zeros(len(data) + 2, bool)
        for k in range(len(data) - window + 1):
            if seen[data[k : k + window]] > 1:
                gone[k + 1 : k + 1 + window] = True
        edges = np.flatnonzero(np.diff(gone))
        keep = np.ones(len(data), bool)
        for a, b in edges.reshape(-1, 2).tolist():
            whole = [m for m in re.finditer(rb"\S+", data) if a <= m.start() and m.end() <= b]
            if len(whole) >= words:
                keep[whole[0].start() : whole[-1].end()] = False
        out[i] = np.frombuffer(data, np.uint8)[keep].tobytes().decode("utf-8", "ignore")
    return out


def passages(texts, words=51):
    """The ids of the documents in which each passage of so many words stands."""
    out = {}
    for i, text in texts.items():
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        for k in range(len(found) - words + 1):
            out.setdefault(" ".join(found[k : k + words]), set()).add(i)
    return out


def test_planted_passages_of_51_to_62_words(spark):
    draw = np.random.default_rng(6)

    def prose(n):
        return [draw.choice(list("abcdefghij"), 3 + k % 6).tolist() for k in range(n)]

    def text(words):
        return " ".join("".join(w) for w in words)

    rows, planted = [], []
    for n in range(45, 63):
        passage = text(prose(n))
        planted.append((n, passage))
        rows += [(len(rows) + k, f"{text(prose(40))} {passage} {text(prose(30))}") for k in range(2)]
    rows += [(len(rows) + k, text(prose(200))) for k in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs.repartition(4), SF).collect()}
    assert found == without_repeats({i: t.encode() for i, t in rows})
    for k, (n, passage) in enumerate(planted):
        for i in (2 * k, 2 * k + 1):
            assert (passage in found[i]) == (n < 51) and len(found[i].split()) >= 70
    assert all(found[i] == t for i, t in rows[-5:])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, frames[-1], SF)
        frames.append(spark.createDataFrame(after.collect(), after.schema))
    raw, good, single, cut, packed = frames
    assert raw.columns == good.columns == single.columns == cut.columns

    scored = {r["doc_id"]: r["predicted"] for r in REGISTRY["op8_quality_classifier"].run(spark, SF).collect()}
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(i for i, p in scored.items() if p)

    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    sets = {i: np.unique(shingle_hashes(t, 5)) for i, t in texts.items()}
    leader = {i: i for i in texts}

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for i in texts:
        for j in texts:
            if i < j:
                both = len(np.intersect1d(sets[i], sets[j]))
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    leader[b] = a
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({find(i) for i in texts})

    datas = {r["doc_id"]: r["text"].encode() for r in single.collect()}
    found = {r["doc_id"]: r for r in cut.collect()}
    want = without_repeats(datas)
    assert {i: r["text"] for i, r in found.items()} == want
    assert all(r["n_chars"] == len(want[i]) for i, r in found.items())
    # by words alone: no passage of 51 words is left that stood in two documents
    before, left = passages({i: d.decode() for i, d in datas.items()}), passages(want)
    assert any(len(ids) > 1 for ids in before.values())
    assert not [p for p in left if len(before.get(p, ())) > 1]
    assert cut.count() == single.count()

    tokens = {}
    for r in packed.collect():
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
        assert r["offset"] + r["length"] <= 4096
    assert set(tokens) == set(datas)


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert found.count() > 0
