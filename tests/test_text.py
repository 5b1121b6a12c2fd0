"""Scalar functions on hand-made sentences; expected values follow the rules, not the code."""

import pytest

from colloquy.functions import text as T
from colloquy.operators import accounts as A, markers as M, meetings as O, recall as R
from colloquy.streaming import jobs as J


@pytest.mark.parametrize(
    "text, due",
    [
        ("Send it by Friday please", "by Friday"),
        ("Send it before the launch, then rest", "before the launch"),
        ("Do it next week or tomorrow", "next week"),
        ("Nothing here", "No deadline stated"),
    ],
)
def test_chunk_deadline(run_one, text, due):
    assert run_one(T.deadline_chunk, text) == due


@pytest.mark.parametrize(
    "text, owner, action",
    [
        ("Priya: I will send the note.", "Priya", "send the note"),
        ("I will send the note.", "Unassigned", "send the note"),
        ("Alex should call the port", "Alex", "call the port"),
        ("We need to call the port", "Unassigned", "call the port"),
        ("Jordan: Nothing to do", "Jordan", "Nothing to do"),
    ],
)
def test_chunk_owner(run_one, text, owner, action):
    got = run_one(T.owner_action_chunk, text)
    assert (got["owner"], got["action"]) == (owner, action)


@pytest.mark.parametrize(
    "raw, value",
    [
        ("five pm on June eighteenth", "2026-06-18 17:00"),
        ("noon on March third", "2026-03-03 12:00"),
        ("midnight on May twenty first", "2026-05-21 00:00"),
        ("12 am on May first", "2026-05-01 00:00"),
        ("whenever it suits", "whenever it suits"),
    ],
)
def test_spoken_datetime(run_one, raw, value):
    assert run_one(M.spoken_datetime, raw) == value


def test_noise_normalize(run_one):
    assert run_one(T.noise_normalize, "remote controller | touch screen") == "remote control . touchscreen"


def test_whitespace_normalize(run_one):
    assert run_one(T.whitespace_normalize, " a\r\nb \t c\n\n\n\nd ") == "a\nb c\n\nd"


def test_similarity_containment_and_overlap(run_one):
    assert run_one(T.text_similarity, "Send the note", "please send the note today") == 1.0
    assert run_one(T.text_similarity, "send red note", "send blue note") == pytest.approx(2 / 3)
    assert run_one(T.text_similarity, "", "x") == 0.0


def test_mask_and_key(run_one):
    assert run_one(O.mask_email, " Jane.Doe@Example.com") == "ja***@example.com"
    assert run_one(O.mask_email, "ab@x.org") == "a***@x.org"
    assert run_one(O.mask_email, "nobody") == ""
    assert run_one(O.storage_key, "s3://bucket/raw/a.mp4") == "raw/a.mp4"
    assert run_one(O.storage_key, "https://x/y.mp4") is None
    assert run_one(O.file_name, "C:\\a\\b/c.txt ") == "c.txt"


def test_file_extension(run_one):
    assert run_one(A.file_extension, "Talk.MP3") == ".mp3"
    assert run_one(A.file_extension, "../up/voice.ogg") == ".ogg"
    assert run_one(A.file_extension, "archive") == ""
    assert run_one(A.file_extension, ".hidden") == ""


def test_error_class_order(run_one):
    code = lambda t, s: O.error_class(t, s)[0]
    assert run_one(code, "transcription timed out", "transcribing") == "processing_timeout"
    assert run_one(code, "bad codec", "Transcribing") == "transcription_failed"
    assert run_one(code, "bad codec", "uploaded") == "processing_failed"


def test_input_hash_ignores_key_order(run_one):
    h = lambda t, p: J.input_hash(t, J.canonical_json(p))
    assert run_one(h, "demo", '{"b":1,"a":"x"}') == run_one(h, "demo", '{"a":"x","b":1}')
    assert run_one(h, "demo", '{"b":1}') != run_one(h, "other", '{"b":1}')


def test_owner_hints(run_one):
    got = run_one(R.owner_hints, ["Owners: Priya for pricing, Jordan for demo and order file, and Alex for notes."])
    assert [(h["owner"], h["keyword"]) for h in got] == [
        ("Priya", "pricing"), ("Jordan", "demo"), ("Jordan", "order file"), ("Alex", "notes"),
    ]


def test_question_answered_later(run_one):
    src = "should we keep lane four later we decided to keep lane four open"
    assert run_one(M.answered_later, "Should we keep lane four?", src) is True
    assert run_one(M.answered_later, "Should we keep lane four?", "should we keep lane four nobody knows") is False
