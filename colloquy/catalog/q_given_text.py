"""Extractors on the given texts: whole documents, and conversations as transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog import query
from colloquy.catalog.cte import oracle
from colloquy.catalog.q_signals import CHUNK_WORDS
from colloquy.functions.arrays import rows
from colloquy.operators import signals as X
from colloquy.sources.conversations import conversation_transcripts
from colloquy.sources.standins import documents, given, spread, text_partitions

DOCUMENTS = {"transcripts": "select doc_id, text from documents"}


def _turns(spark, sf):
    return spread(conversation_transcripts(given(spark, sf, "conversations")), text_partitions(spark))


# No oracle for the cue signals here: a word border next to a letter like "ü" is Unicode in Spark, as
# in the reference semantics, and ASCII in the oracle's engine, so owners before such letters differ.
@query("x02_cue_signals_documents")
def x02_documents(spark, sf):
    return X.cue_signals(documents(spark, sf))


@query("x02_cue_signals_conversations")
def x02_conversations(spark, sf):
    return X.cue_signals(_turns(spark, sf))


def _merged(docs):
    merged = X.consolidate(X.chunk_candidates(F.col("text"), CHUNK_WORDS))
    return rows(docs, merged, ["doc_id"], "c").select("doc_id", "pos", "c.action", "c.owner", "c.deadline")


MERGED_SQL = """select doc_id, row_number() over (partition by doc_id order by c.chunk, i) as pos, c.action as action, c.owner as owner, c.deadline as deadline
    from (select doc_id, unnest(m) as c, generate_subscripts(m, 1) as i from chunk_merged) t"""


@query("a12_action_consolidate_documents", oracle(MERGED_SQL, DOCUMENTS))
def a12_documents(spark, sf):
    return _merged(documents(spark, sf))
