import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rowan.llm.chunks import split_oversized, split_text

STATES = "state_id bigint, chunk_text string, chunk_record struct<chunk_id:string,strategy:string,unit:string,char_start:bigint,char_end:bigint,char_count:bigint,page_start:bigint,page_end:bigint,page_count:bigint>, policy_id bigint, ingested_at timestamp, piece string, cut string"
POLICIES = "policy_id bigint, strategy string, max_chunk_size bigint, overlap bigint"


@given(st.text(alphabet="abcxyz .\n。!", max_size=120), st.integers(1, 20), st.integers(0, 19))
@settings(max_examples=400, deadline=None)
def test_pieces_hold_all_promises(text, most, overlap):
    overlap = min(overlap, most - 1)
    pieces = split_text(text, most, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(e - s <= most for s, e, _ in pieces)
    assert all(a < c <= b < d and b - c <= overlap for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]))
    long_run = re.search(r"[^\s.!?。！？]{%d}" % (most + 1), text) is not None
    assert any(k == "hard" for *_, k in pieces) == long_run


def test_sizes_in_tokens():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", ","]) for _ in range(300))
    pieces = split_text(text, 25, 5, "token")
    count = lambda s: len(re.findall(r"\w+|[^\w\s]+", s))
    assert all(count(text[s:e]) <= 26 for s, e, _ in pieces) and pieces[-1][1] == len(text)
    assert "".join(text[max(s, b) : e] for (s, e, _), b in zip(pieces, [0] + [e for _, e, _ in pieces])) == text


def test_natural_boundaries_come_first():
    text = "One two three. Four five six.\n\nSeven eight nine ten. Eleven twelve"
    assert [k for *_, k in split_text(text, 40, 0)] == ["paragraph", "end"]
    short = "aaa bbb. ccc ddd eee"
    assert [short[s:e] for s, e, _ in split_text(short, 12, 0)] == ["aaa bbb. ", "ccc ddd eee"]


def test_operator(spark):
    record = ("chunk_3", "page", "char", 100, 160, 1, 2, 2, 1)
    t = "The first sentence is here. " * 9
    rows = [
        (1, t, record, 1, None, "x", "y"),
        (1, t, record, 1, None, "x", "y"),
        (2, "x" * 95 + " end", None, 1, None, None, None),
        (3, "short", record, 1, None, None, None),
        (4, None, record, 1, None, None, None),
        (5, "", None, 1, None, None, None),
        (6, t, None, None, None, None, None),
        (7, t, None, 99, None, None, None),
        (8, t, None, 2, None, None, None),
        (9, t, None, 3, None, None, None),
    ]
    states = spark.createDataFrame(rows, STATES)
    policies = spark.createDataFrame([(1, "section", 60, 10), (2, None, 60, None), (3, "bad", 0, 0), (4, "bad", None, 0)], POLICIES)
    out = split_oversized(states, policies).collect()
    by = {}
    for r in out:
        by.setdefault(r.state_id, []).append(r)
    assert set(by) == {1, 2, 3, 8}
    assert {k: v[0].cut for k, v in by.items()} == {1: "soft", 2: "hard", 3: "none", 8: "soft"}
    for r in by[1]:
        c = r.chunk_record
        assert t[c.char_start - 100 : c.char_end - 100] == r.chunk_text and c.char_count == len(r.chunk_text) and c.strategy == "section" and c.page_start == 2
    assert [r.piece for r in sorted(by[1], key=lambda r: r.piece)] == list(range(len(by[1]))) and by[1][0].pieces == len(by[1])
    assert split_oversized(states.limit(0), policies).count() == 0
    assert split_oversized(states, policies.limit(0)).count() == 0


def test_very_long_text():
    pieces = split_text("word " * 400_000, 3000, 20)
    assert pieces[-1][1] == 2_000_000 and all(k != "hard" for *_, k in pieces)
    assert len(split_text("x" * 1_000_000, 1000, 100)) == 1111
