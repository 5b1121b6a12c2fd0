import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import suffixes
from colloquy.llm.everything import REGISTRY


def brute(docs, window):
    datas = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(d[k : k + window] for _, d in datas for k in range(len(d) - window + 1))
    out = []
    for i, data in datas:
        cut = np.zeros(len(data), bool)
        for k in range(len(data) - window + 1):
            if seen[data[k : k + window]] > 1:
                cut[k : k + window] = True
        kept = np.frombuffer(data, np.uint8)[~cut].tobytes()
        runs = int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum())
        out.append((i, len(data), int(cut.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def mixed(draw):
    def noise(n):
        return "".join(draw.choice(list("abcd"), n))

    passages = [noise(n) for n in (30, 45, 60, 25, 80)]
    docs = []
    for i in range(50):
        text = ""
        for _ in range(int(draw.integers(0, 6))):
            p = passages[int(draw.integers(0, 5))]
            text += noise(int(draw.integers(0, 40))) + p[int(draw.integers(0, 8)) : len(p) - int(draw.integers(0, 8))]
        docs.append((i, text))
    more = [None, "", "a" * 200, "ab" * 100, docs[3][1], docs[3][1], docs[7][1], "é" * 30, "x" + "é" * 30]
    return docs + list(enumerate(more, 100)) + [(7, docs[7][1]), (None, docs[8][1]), (None, docs[8][1])]


@pytest.mark.parametrize(("window", "gram", "hot", "bucket"), [(24, 12, 256, 50), (24, 12, 3, 10), (40, 10, 256, 1000), (16, 16, 5, 7)])
def test_equals_brute_force(spark, window, gram, hot, bucket):
    docs = mixed(np.random.default_rng(window + hot))
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, data string").repartition(3)
    found = suffixes.remove_repeats(frame, window, gram, "bytes", hot, bucket).collect()
    assert sorted(((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found), key=str) == brute(docs, window)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and r["row"]["data"] == "x" for r in found)


def brute_passages(docs, window, words):
    """(doc_id, passages, their bytes, what is left): runs of repeated windows that hold so many whole words."""
    datas = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(d[k : k + window] for _, d in datas for k in range(len(d) - window + 1))
    out = []
    for i, data in datas:
        cut = np.zeros(len(data) + 2, int)
        for k in range(len(data) - window + 1):
            if seen[data[k : k + window]] > 1:
                cut[k + 1 : k + 1 + window] = 1
        found = []
        for a, b in np.flatnonzero(np.diff(cut)).reshape(-1, 2).tolist():
            whole = [m for m in re.finditer(rb"\S+", data) if a <= m.start() and m.end() <= b]
            if len(whole) >= words:
                found.append((whole[0].start(), whole[-1].end()))
        kept = data
        for a, b in reversed(found):
            kept = kept[:a] + kept[b:]
        out.append((i, len(found), sum(b - a for a, b in found), kept.decode("utf-8", "ignore")))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "gram", "fine", "fine_gram", "hot"), [(40, 20, 24, 12, 256), (40, 20, 20, 8, 3), (24, 12, 24, 12, 256)])
def test_both_rules_equal_brute_force(spark, window, gram, fine, fine_gram, hot):
    draw = np.random.default_rng(window + hot)
    docs = [(i, t and re.sub("d", " ", t) if draw.integers(0, 3) else t) for i, t in mixed(draw)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, data string").repartition(3)
    found = suffixes.remove_repeats(frame, window, gram, "text", hot, 50, passages=(fine, fine_gram, 5)).collect()
    assert sorted(((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found), key=str) == brute(docs, window)
    passages = brute_passages(docs, fine, 5)
    assert sorted(((r["row"]["doc_id"], r["n_passages"], r["passage_bytes"], r["passage_text"]) for r in found), key=str) == passages
    assert any(p[1] for p in passages)


def test_query_cuts_passages_of_over_50_words(spark, folder):
    """Passages of 45 to 62 words, most of them under 400 bytes; the contract's columns judge 400 bytes alone."""
    draw = np.random.default_rng(3)

    def prose(n):
        return " ".join("".join(draw.choice(list("abcdefghij"), 3 + k % 6)) for k in range(n))

    passages = {n: prose(n) for n in range(45, 63)}
    docs = [(2 * n + k, f"{prose(40)} {p} {prose(30)}") for n, p in passages.items() for k in range(2)]
    docs += [(k, prose(150)) for k in range(9)] + [(200, docs[0][1]), (201, None), (202, "")]
    path = folder(documents=[(i, t, "en", "s", len(t or "")) for i, t in docs])
    found = REGISTRY["op9_suffix_dedup"].run(spark, path).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute(docs, 400)
    assert sorted(((r["doc_id"], r["n_passages"], r["passage_bytes"], r["passage_text"]) for r in found), key=str) == brute_passages(docs, 200, 51)
    texts = {r["doc_id"]: r["passage_text"] for r in found}
    short = [n for n in passages if n > 50 and len(passages[n]) < 400]
    assert len(short) > 5
    for n, p in passages.items():
        if n > 45:
            assert (p in texts[2 * n]) == (p in texts[2 * n + 1]) == (n < 51)
    assert texts[90] == texts[200] == "" and all(texts[i] == t for i, t in docs if i < 9)


def test_blocks_of_a_long_text(monkeypatch):
    draw = np.random.default_rng(6)
    data = bytes(draw.integers(97, 101, 3000, dtype=np.uint8))
    whole = suffixes.contexts_of(data, 40, 20)
    monkeypatch.setattr(suffixes, "BLOCK", 256)
    parts = suffixes.contexts_of(data, 40, 20)

    def anchors(found):
        return {p: (a, k) for s, n, a, k in zip(*found, strict=True) for p in range(s, s + n)}

    assert anchors(whole) == anchors(parts) and len(anchors(whole)) == 3000 - 39


def test_loser_tree_merges_and_tells_common_prefixes():
    draw = np.random.default_rng(8)
    strings = [bytes(draw.integers(97, 99, draw.integers(0, 12), dtype=np.uint8)) for _ in range(300)]
    for count in (1, 2, 5, 8):
        runs = []
        for r in range(count):
            some, before, run = sorted(strings[r::count]), b"", []
            for s in some:
                shared = suffixes.common(before, s, 0)
                run.append((shared, s[shared:]))
                before = s
            runs.append(run)
        merged = list(suffixes.LoserTree(runs))
        assert [m[2] for m in merged] == sorted(strings)
        assert [m[3] for m in merged[1:]] == [suffixes.common(a[2], b[2], 0) for a, b in zip(merged, merged[1:], strict=False)]


def test_query_on_the_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = REGISTRY["op9_suffix_dedup"].run(spark, sf_dir).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute(docs, 400)
    whole = [r for r in found if "\ufffd" not in r["text"] and len(r["text"].encode()) == r["n_bytes"] - r["n_removed"]]
    assert len(whole) > 0.9 * len(found)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in whole)


def test_key_ranges_are_even(spark):
    draw = np.random.default_rng(11)
    grams = np.concatenate([suffixes.contexts_of(bytes(draw.integers(97, 123, 60_000, dtype=np.uint8)), 400, 200)[3] for _ in range(4)])
    counts = np.bincount((grams >> np.uint64(60)).astype(int), minlength=16)
    assert counts.min() > 0.5 * counts.mean() and counts.max() < 1.6 * counts.mean()
