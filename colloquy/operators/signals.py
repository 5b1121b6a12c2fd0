"""Cue, chunk and slot extractors: transcripts to typed item rows, inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import chains as C, lexicons as L, patterns as J, text as T
from colloquy.functions.arrays import head, keep_first, let
from colloquy.operators import sentences as S

ITEM = "struct<text:string,owner:string,deadline:string>"


def item(text: Column, owner: Column | None = None, deadline: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        text.alias("text"),
        (none if owner is None else owner).alias("owner"),
        (none if deadline is None else deadline).alias("deadline"),
    )


def kind_rows(df: DataFrame, keys: list[str], kinds: dict[str, Column]) -> DataFrame:
    """One row per item of several kinds, each numbered within its kind."""
    def tag(kind: str, items: Column) -> Column:
        return F.transform(
            items,
            lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("pos"), x.alias("x")),
        )

    packed = [tag(kind, items) for kind, items in kinds.items()]
    out = df.select(*keys, F.explode_outer(F.concat(*packed)).alias("r"))
    return out.filter(F.col("r").isNotNull()).select(*keys, "r.kind", F.col("r.pos").cast("long").alias("pos"), "r.x.*")


# ---- X02 -------------------------------------------------------------------------------
def cued(s: Column, cues: tuple[str, ...]) -> Column:
    """Whether any cue occurs; a list that was replaced by an empty one finds nothing."""
    return T.has_any(s, cues) if cues else F.lit(False)


def cue_decisions(sents: Column, cues=L.SIGNAL_DECISION, limit: int = 14) -> Column:
    hits = F.filter(sents, lambda s: cued(s, cues))
    return keep_first(
        F.transform(hits, lambda s: C.apply(s, C.SIGNAL_DECISION)), T.sorted_token_key, limit
    )


def cue_risks(sents: Column, cues=L.SIGNAL_RISK, limit: int = 16, none=L.SIGNAL_NO_RISK) -> Column:
    hits = F.filter(sents, lambda s: cued(s, cues) & ~cued(s, none))
    return keep_first(
        F.transform(hits, lambda s: C.apply(s, C.SIGNAL_RISK)), T.sorted_token_key, limit
    )


def cue_actions(sents: Column, cues=L.SIGNAL_ACTION, limit: int = 14) -> Column:
    hits = F.transform(
        F.filter(sents, lambda s: cued(s, cues)),
        lambda s: F.struct(s.alias("s"), T.owner_signal(s).alias("owner")),
    )
    owned = F.filter(hits, lambda h: h["owner"].isNotNull() | F.lower(h["s"]).contains("action"))
    items = F.transform(
        owned,
        lambda h: item(
            T.strip_edges(h["s"], T.EDGE_V1), h["owner"], T.first_group(h["s"], f"(?i){L.SIGNAL_DATE}")
        ),
    )
    return keep_first(
        items, lambda x: T.sorted_token_key(F.concat_ws(" ", x["owner"], x["text"])), limit
    )


CUE_LISTS = {
    "SIGNAL_DECISION": L.SIGNAL_DECISION,
    "SIGNAL_ACTION": L.SIGNAL_ACTION,
    "SIGNAL_RISK": L.SIGNAL_RISK,
    "SIGNAL_NO_RISK": L.SIGNAL_NO_RISK,
}


def cue_signals(df: DataFrame, lists: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Decisions, actions and risks by cue lists, each deduped on its token set.

    ``lists`` replaces those of ``CUE_LISTS`` that it names, as ``load_lexicons`` gives them.
    """
    cues = CUE_LISTS | (lists or {})
    # a column of its own, so the three kinds share one split
    split = df.withColumn("sents", S.sentences_signal(F.col("text")))
    sents = F.col("sents")
    kinds = {
        "decision": F.transform(cue_decisions(sents, cues["SIGNAL_DECISION"]), lambda s: item(s)),
        "action": cue_actions(sents, cues["SIGNAL_ACTION"]),
        "risk": F.transform(cue_risks(sents, cues["SIGNAL_RISK"], none=cues["SIGNAL_NO_RISK"]), lambda s: item(s)),
    }
    return kind_rows(split, ["doc_id"], kinds)


# ---- X03, A12 --------------------------------------------------------------------------
CANDIDATE = (
    "struct<action:string,owner:string,deadline:string,reason_context:string,"
    "related_decision:string,related_risk:string,source_chunk:int,confidence:string>"
)


def chunk_candidates(text: Column, chunk_words: int = 900, markers=L.CHUNK_MARKERS) -> Column:
    """Array of candidate actions over word chunks."""

    def of_chunk(c: Column) -> Column:
        acting = F.filter(
            S.statements(c["text"]),
            lambda s: T.has_any(F.concat(F.lit(" "), s, F.lit(" ")), markers),
        )
        found = F.transform(
            acting, lambda s: F.struct(s.alias("s"), T.owner_action_chunk(s).alias("oa"))
        )
        return F.transform(
            F.filter(found, lambda f: f["oa"]["action"] != ""),
            lambda f: F.struct(
                f["oa"]["action"].alias("action"),
                f["oa"]["owner"].alias("owner"),
                T.deadline_chunk(f["s"]).alias("deadline"),
                f["s"].alias("reason_context"),
                F.lit("").alias("related_decision"),
                F.lit("").alias("related_risk"),
                c["chunk"].cast("int").alias("source_chunk"),
                T.confidence_label(f["oa"]["owner"], f["s"]).alias("confidence"),
            ),
        )

    return F.flatten(F.transform(S.word_chunks(text, chunk_words), of_chunk))


def _rank(confidence: Column) -> Column:
    low = F.lower(confidence)
    return F.when(low == "low", 1).when(low == "medium", 2).when(low == "high", 3).otherwise(0)


def consolidate(candidates: Column, threshold: float = 0.75) -> Column:
    """Merge candidates of one owner and deadline whose texts are similar, in chunk order.

    The fold state carries normalized text and tokens, computed once per candidate.  The
    merged text becomes the one later candidates are compared with, so order matters and
    the fold runs over one transcript's own candidates.
    """
    full = (
        f"struct<c:{CANDIDATE},owner_key:string,due_key:string,norm:string,tokens:array<string>>"
    )

    def enrich(c: Column) -> Column:
        return F.struct(
            c.alias("c"),
            F.lower(T.squash(c["owner"])).alias("owner_key"),
            F.lower(T.squash(c["deadline"])).alias("due_key"),
            F.lower(T.squash(c["action"])).alias("norm"),
            T.stripped_tokens(c["action"]).alias("tokens"),
        ).cast(full)

    ordered = F.transform(
        F.sort_array(
            F.transform(
                candidates,
                lambda c, i: F.struct(c["source_chunk"].alias("k"), i.alias("i"), c.alias("c")),
            )
        ),
        lambda s: enrich(s["c"]),
    )

    def same(a: Column, b: Column) -> Column:
        inside = F.contains(a["norm"], b["norm"]) | F.contains(b["norm"], a["norm"])
        close = (a["norm"] != "") & (b["norm"] != "") & (
            inside | (T.overlap(a["tokens"], b["tokens"]) >= threshold)
        )
        return (a["owner_key"] == b["owner_key"]) & (a["due_key"] == b["due_key"]) & close

    def merge(a: Column, b: Column) -> Column:
        better = F.size(b["tokens"]) > F.size(a["tokens"])
        pick = F.when(better, b).otherwise(a)
        l, r = a["c"], b["c"]
        longer = F.length(F.trim(r["reason_context"])) > F.length(F.trim(l["reason_context"]))
        c = F.struct(
            pick["c"]["action"].alias("action"),
            pick["c"]["owner"].alias("owner"),
            pick["c"]["deadline"].alias("deadline"),
            F.when(longer, r["reason_context"]).otherwise(l["reason_context"]).alias("reason_context"),
            F.when(l["related_decision"] != "", l["related_decision"])
            .otherwise(r["related_decision"])
            .alias("related_decision"),
            F.when(l["related_risk"] != "", l["related_risk"])
            .otherwise(r["related_risk"])
            .alias("related_risk"),
            F.least(l["source_chunk"], r["source_chunk"]).alias("source_chunk"),
            F.when(_rank(r["confidence"]) > _rank(l["confidence"]), r["confidence"])
            .otherwise(l["confidence"])
            .alias("confidence"),
        )
        return F.struct(
            c.alias("c"),
            pick["owner_key"].alias("owner_key"),
            pick["due_key"].alias("due_key"),
            pick["norm"].alias("norm"),
            pick["tokens"].alias("tokens"),
        ).cast(full)

    def step(acc: Column, cand: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda e: same(e, cand)), F.lit(True))
        return let(
            at,
            lambda p: F.when(p == 0, F.concat(acc, F.array(cand))).otherwise(
                F.transform(acc, lambda e, i: F.when(i + 1 == p, merge(e, cand)).otherwise(e))
            ),
        ).cast(f"array<{full}>")

    merged = F.aggregate(ordered, F.array().cast(f"array<{full}>"), step)
    back = F.sort_array(
        F.transform(
            merged,
            lambda s, i: F.struct(s["c"]["source_chunk"].alias("k"), i.alias("i"), s["c"].alias("c")),
        )
    )
    return F.transform(back, lambda s: s["c"])


# ---- X04, A13, A14, P18 -----------------------------------------------------------------
SLOT_ITEM = "struct<kind:string,text:string,owner:string,due:string,confidence:double,chunk:int>"


def is_purpose(s: Column) -> Column:
    return T.has_any(s, L.SLOT_PURPOSE) & ~F.lower(s).contains("next step")


def is_outcome(s: Column) -> Column:
    low = F.lower(s)
    hit = low.rlike(J.ahead("by the end|we should leave with|^confirmed|outcome|result"))
    return ~is_purpose(s) & hit


def is_slot_action(s: Column) -> Column:
    low = F.lower(s)
    blocked = (
        is_purpose(s)
        | is_outcome(s)
        | T.has_any(s, L.SLOT_DECISION)
        | low.rlike(J.ahead("by the end of the meeting|we should leave with"))
    )
    asks = (
        s.rlike(J.ahead(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)? will\b"))
        | low.rlike(J.ahead(L.starts(L.SLOT_STARTERS)))
        | T.has_any(F.concat(F.lit(" "), s, F.lit(" ")), L.SLOT_TASK)
    )
    return ~blocked & asks


def slot_items(chunks: Column, max_points: int = 12) -> Column:
    """One pass over the chunks' sentences to typed items in text order."""

    def of_chunk(text: Column, chunk: Column) -> Column:
        sents = F.filter(S.sentences_slot(text), lambda s: F.length(s) >= 12)

        def of_sentence(s: Column) -> Column:
            owner, due = T.owner_slot(s), T.deadline_slot(s)
            confidence = (
                F.lit(0.70)
                + F.when(owner.isNotNull(), 0.10).otherwise(0.0)
                + F.when(due.isNotNull(), 0.10).otherwise(0.0)
            )
            none = F.lit(None).cast("string")

            def one(kind: str, test: Column, conf: Column, own: Column = none, when: Column = none):
                made = F.struct(
                    F.lit(kind).alias("kind"),
                    s.alias("text"),
                    own.alias("owner"),
                    when.alias("due"),
                    conf.alias("confidence"),
                    chunk.alias("chunk"),
                ).cast(SLOT_ITEM)
                return F.when(test, made)

            found = F.array(
                one("purpose", is_purpose(s), F.lit(1.0)),
                one("outcome", is_outcome(s), F.lit(1.0)),
                one("decision", T.has_any(s, L.SLOT_DECISION), F.lit(0.82)),
                one("risk", T.has_any(s, L.SLOT_RISK), F.lit(0.78)),
                one("next_step", T.has_any(s, L.SLOT_NEXT), F.lit(1.0)),
                one("action", is_slot_action(s), F.least(confidence, F.lit(0.95)), owner, due),
                one("key_point", F.lit(True), F.lit(1.0)),
            )
            return F.filter(found, lambda x: x.isNotNull())

        return F.flatten(F.transform(sents, of_sentence))

    every = F.flatten(F.transform(chunks, lambda t, i: of_chunk(t, i)))

    def first(kind: str, n: int) -> Column:
        return lambda a: head(F.filter(a, lambda x: x["kind"] == kind), n)

    def cut(a: Column) -> Column:
        rest = F.filter(a, lambda x: ~x["kind"].isin("purpose", "outcome", "key_point"))
        return F.concat(
            first("purpose", 1)(a), first("outcome", 1)(a), rest, first("key_point", max_points)(a)
        )

    return let(every, cut)


def of_kind(items: Column, kind: str) -> Column:
    return F.filter(items, lambda x: x["kind"] == kind)


def best_by_key(items: Column) -> Column:
    """Per normalized text the row of highest confidence, ties to the first."""

    def firsts(keys: Column, a: Column) -> Column:
        def best(k: Column) -> Column:
            same = F.filter(a, lambda s: s["k"] == k)
            ranked = F.sort_array(
                F.transform(
                    same, lambda s, i: F.struct((-s["x"]["confidence"]).alias("c"), i.alias("i"), s["x"].alias("x"))
                )
            )
            return ranked[0]["x"]

        return F.transform(keys, best)

    return _grouped(items, firsts)


def _grouped(items: Column, build) -> Column:
    keyed = F.filter(
        F.transform(items, lambda x: F.struct(T.merge_key(x["text"]).alias("k"), x.alias("x"))),
        lambda s: s["k"] != "",
    )
    return let(keyed, lambda a: build(F.array_distinct(a["k"]), a))


def merge_slot_actions(items: Column) -> Column:
    """Per key the first text, max confidence, first owner and due, all chunk ids."""

    def build(keys: Column, a: Column) -> Column:
        def one(k: Column) -> Column:
            same = F.transform(F.filter(a, lambda s: s["k"] == k), lambda s: s["x"])
            return let(
                same,
                lambda g: F.struct(
                    g[0]["text"].alias("text"),
                    F.get(F.filter(g["owner"], lambda o: o.isNotNull()), F.lit(0)).alias("owner"),
                    F.get(F.filter(g["due"], lambda d: d.isNotNull()), F.lit(0)).alias("due"),
                    F.array_max(g["confidence"]).alias("confidence"),
                    F.sort_array(F.array_distinct(g["chunk"])).alias("chunks"),
                ),
            )

        return F.transform(keys, one)

    return _grouped(items, build)


def by_confidence(items: Column, limit: int) -> Column:
    """Stable sort by falling confidence, capped."""
    ranked = F.sort_array(
        F.transform(
            items, lambda x, i: F.struct((-x["confidence"]).alias("c"), i.alias("i"), x.alias("x"))
        )
    )
    return head(F.transform(ranked, lambda s: s["x"]), limit)


# fixed values: tests of a finished action
STATUS_HINTS = (
    "we discussed", "we reviewed", "we talked about", "already done", "has been done",
    "was fixed", "was completed", "completed", "finished",
)
DECIDED_HINTS = ("we agreed", "agreed that", "decided", "approved", "chosen")
FRAME_HINTS = (
    "by the end of the meeting", "we should leave with", "purpose of this meeting",
    "goal of this meeting",
)


def valid_actions(items: Column, limit: int = 6) -> Column:
    """Long, confident, task-like actions that are no status, decision or frame."""
    tidy = F.transform(
        items, lambda x: x.withField("text", T.strip_edges(T.squash(x["text"]), r"[ \-•]+"))
    )

    def ok(x: Column) -> Column:
        low = F.lower(x["text"])
        task_like = (
            low.rlike(J.ahead(L.starts(L.SLOT_STARTERS)))
            | T.has_any(F.concat(F.lit(" "), x["text"], F.lit(" ")), L.SLOT_TASK)
            | (x["owner"].isNotNull() & low.rlike(J.ahead(r"\bwill\b|\bshould\b|\bneed[s]? to\b")))
        )
        return (
            (F.length(x["text"]) >= 12)
            & (x["confidence"] >= 0.65)
            & ~T.has_any(x["text"], STATUS_HINTS + DECIDED_HINTS + FRAME_HINTS)
            & task_like
            & ~(low.startswith("we ") & x["owner"].isNull())
        )

    return keep_first(F.filter(tidy, ok), lambda x: F.lower(x["text"]), limit)
