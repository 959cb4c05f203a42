import itertools

import numpy as np

from rowan.llm.quality import measure, text_quality, viterbi

PROSE = "The committee kept the list going until it was closed in 1972. No one had compared the two tables before, although both of them were there. It took two days to copy all of the rows by hand."
WRAPPED = "The committee kept the list going\nuntil it was closed in 1972. No one had\ncompared the two tables before, although\nboth of them were there and it took two days\nto copy all of the rows by hand."
LIST = "\n".join(f"- Item Number{i} of Placeby" for i in range(12))
PLAIN_LIST = "\n".join(f"Placeby Rovers {i}" for i in range(12))
TABLE = "name | size | year\n" + "\n".join(f"Placeby | {i}.5 | 19{i}" for i in range(10, 22))
TABBED = "\n".join(f"Placeby\t{i}.5\t19{i}\tx" for i in range(10, 22))
HEX = "\n".join(f"{i:08x}  7f 45 4c 46 02 01 01 00 1f 3a" for i in range(12))


def kind(text):
    return ["prose", "list", "table", "junk", "blank"][measure([text], 0.4)["kind"][0]]


def test_kinds():
    assert kind(PROSE) == kind(WRAPPED) == kind(PROSE.lower().replace(".", "").replace(",", "")) == "prose"
    assert kind(f"{PROSE} {PROSE}\n\n- a\n- b\n\n{PROSE}") == "prose"
    assert kind(LIST) == kind(PLAIN_LIST) == kind("An opening sentence stands here.\n" + LIST) == "list"
    assert kind(TABLE) == kind(TABBED) == "table"
    assert kind(HEX) == kind("\n".join(["=" * 60] * 5)) == kind("\n".join(["The same line again."] * 30)) == "junk"
    assert kind("この列の値は文字列なので、数値に直してから並べ替えた。最後の行は合計なので、取り除いた。") == "prose"
    assert kind("") == kind(" \n\t\n") == kind("　") == "blank"


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    transition, start = np.log(rng.dirichlet(np.ones(3), 3)), np.log(np.ones(3) / 3)
    count = np.array([3, 0, 5, 1])
    emission = np.log(rng.random((9, 3)))
    first = np.array([0, 3, 3, 8])
    path = viterbi(emission, first, count, transition, start)
    for f, c in zip(first, count):
        score = lambda p: start[p[0]] + emission[f, p[0]] + sum(transition[a, b] + emission[f + i + 1, b] for i, (a, b) in enumerate(itertools.pairwise(p)))  # noqa: E731, B023
        if c:
            assert tuple(path[f : f + c]) == max(itertools.product(range(3), repeat=int(c)), key=score)


def test_operator(spark):
    rows = [(1, PROSE, "x"), (2, LIST, "y"), (2, LIST, "y"), (3, None, None), (None, "", None), (4, "word " * 200_000, "z"), (5, "a\x00b ퟿ \U0001f600", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    out = text_quality(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[1].words == len(PROSE.split()) and by[1].kind == "prose" and by[1].sentence_line_share == 1.0
    assert abs(by[4].mean_word_length - 4) < 1e-9 and by[4].words == 200_000
    assert by[3].kind == by[None].kind == "blank" and by[3].words == 0
    assert abs(by[2].list_share + by[2].prose_share + by[2].table_share + by[2].junk_share - 1) < 1e-9
    assert text_quality(df.limit(0)).count() == 0
