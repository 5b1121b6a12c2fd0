"""The audit against a removal done row by row, order by order."""

import random
import re
from collections import Counter
from itertools import permutations

from colloquy.llm import filter_audit
from colloquy.llm.everything import REGISTRY

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(text, doc_id, ids_of):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if doc_id is not None and any(i < doc_id for i in ids_of[text]):
        out.add("E")
    return out


def by_hand(docs, labels):
    docs = [(i, t or "", lang or "") for i, t, lang in docs]
    ids_of = {t: [i for i, u, _ in docs if u == t and i is not None] for _, t, _ in docs}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows, shapley = {}, Counter()
    judged = [(i, lang, failed(t, i, ids_of)) for i, t, lang in docs]
    for part in {lang for _, lang, _ in judged}:
        mine = [(i, f) for i, lang, f in judged if lang == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                rows[part, "".join(order), step] = dict(
                    kept=len(left),
                    removed=len(gone),
                    redundant=sum(name in f for _, f in mine) - len(gone),
                    unique_fails=sum(f == {name} for _, f in mine),
                    good_lost=sum(i in good for i, _ in gone),
                    toxic_lost=sum(i in toxic for i, _ in gone),
                )
                shapley[part, name] += len(gone)
    for (part, order, step), row in rows.items():
        row["shapley"] = shapley[part, order[step - 1]]
    return rows


def told(found):
    rows = found.collect()
    out = {(r["part"], r["filter_order"], r["step"]): {c: r[c] for c in COUNTS} for r in rows}
    assert len(out) == len(rows)
    return out


def texts(draw):
    long = " ".join(f"w{k}" for k in range(200))
    pool = [None, "", " \n\t", "one", "One TWO", "50 % off", long, long + " $", long.upper(), "a a a b " * 60, "x y z " * 70, "\x0b\x0c\x1c a"]
    return [draw.choice(pool) for _ in range(150)]


def test_random_rows_against_removal_by_hand(spark):
    draw = random.Random(3)
    docs = [(draw.choice([None, *range(60)]), t, draw.choice(["en", "de", "", None])) for t in texts(draw)]
    labels = [(draw.choice([None, *range(60)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = by_hand(docs, labels)
    for part_rows in (filter_audit.PART_ROWS, 2):
        assert told(filter_audit.audit(frame, marks, part_rows)) == want


def test_the_query_on_a_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert told(REGISTRY["op13_filter_audit"].run(spark, sf_dir)) == by_hand(docs, labels)


def test_clashing_columns_and_no_rows(spark):
    names = "h1 h2 part bits n rows good toxic s own before salt first_id parts low high c label_id".split()
    wide = "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names)
    docs = [(1, "a", None, *names), (2, "a", "", *names)]
    frame = spark.createDataFrame(docs, wide)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert told(filter_audit.audit(frame, labels)) == by_hand([d[:3] for d in docs], [])
    assert filter_audit.audit(frame.where("false"), labels).count() == 0
