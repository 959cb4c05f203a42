import json
import random
import time

import pytest

from rowan.llm.pairs import DEFECTS, breaks_off, defect_of, defect_report, inner_stack, parse, response_defects, tiles

Q = "Which club had the highest turnout in 1967?"


@pytest.mark.parametrize(
    "prompt, response, defect",
    [
        (Q, None, "empty"), (Q, "", "empty"), (Q, " \n​", "empty"), (Q, "``````", "empty"), (Q, "```json\n```", "empty"), (Q, '{"answer": null}', "empty"),
        (Q, "<p></p>", "empty"), (Q, "null", "empty"), (Q, "[]", "empty"), (Q, "0", None), (Q, "no", None), (Q, "Rossby Millers", None), (Q, "1. Aby: 12\n2. Bem: 13", None),
        (Q, "1. Aby: 12\n2. Bem:", "truncated"), (Q, "1. Aby: 12\n2.", "truncated"), (Q, '{"answer": ["Aby", "Be', "truncated"), (Q, "```json\n{\"a\": 1}", "truncated"),
        (Q, "It was the club that", "truncated"), (Q, "It was Aby. The row names Bem and the", "truncated"), (Q, "Aby, Bem,", "truncated"), (Q, "only in part", None), (Q, "Aby; Bem", None),
        (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, '{"error": "I must decline this request."}', "refusal"), (Q, "Leider kann ich diese Frage nicht beantworten.", "refusal"),
        (Q, "Je ne peux pas répondre à cette question.", "refusal"), (Q, "Lo siento, no puedo responder.", "refusal"), (Q, "申し訳ありませんが、お答えできません。", "refusal"),
        (Q, "Sorry to say that two clubs tie: Aby and Bem both show 12.", None), (Q, 'The cell reads "I cannot say", and that is the whole entry.', None), (Q, "Aby declined to be counted, so Bem came first.", None),
        (Q, Q, "copy"), (Q, Q.upper(), "copy"), (Q, f"**{Q}**", "copy"), (Q, f"{Q}\n{Q}", "copy"), (Q, f"{Q} It was Aby Millers.", None), ("Name every place whose yield fell below 10 in March.", "name every place whose yield fell below 10 in march.", "copy"),
        (Q, "Das steht nicht in der Tabelle.", "other_language"), (Q, "Ce n'est pas dans le tableau.", "other_language"), (Q, "それは表にはありません。", "other_language"),
        (Q + " Answer in German.", "Das steht nicht in der Tabelle.", None), (Q + " Answer in German.", "Eso no está en la tabla.", "other_language"), ("Wie viele Zeilen nennen Aby nach 1950?", "Es gibt 12 solche Zeilen.", None),
        (None, "It was Aby.", None), ("", "Das steht nicht in der Tabelle.", None), (Q, "x" * 100_000, None), (Q, '{"a": ' + "[" * 50_000, "truncated"), (Q, "[" * 50_000, "empty"),
    ],
)
def test_defects(prompt, response, defect):
    assert defect_of(prompt, response) == defect


@pytest.mark.parametrize(
    "response, defect",
    [
        ("<answer>The total is 5.", "truncated"), ("The total (see the note in table 3 is 5.", "truncated"), ('He said "the total is 5.', "truncated"), ('Here is the result: {"a": [1, 2', "truncated"),
        ("<answer>Aby Harriers", "truncated"), ('"Aby Har', "truncated"), ("Aby Harriers (4668", "truncated"), ("1) one\n2) two\n3)", "truncated"), ("«Aby» and «Bem", "truncated"),
        ("<p>Aby won.</p><p>Bem lost.", None), ('Pipes of 5" and of 6" are used.', None), ('He said "yes". It is 5.', None), ("x < y and a > b holds in the table.", None), ("It is 5 :(", None),
        ("Ajax won the game against Inter Milan", None), ("Red Bull Racing won the title in Austria", None), ("It was the turn", "truncated"),
        ("I'm afraid that isn't something I do.", "refusal"), ("Desculpe, mas não posso responder a essa pergunta.", "refusal"), ("Thank you. I looked at the table. It has columns. I cannot answer that.", "refusal"),
        ("The year could not be identified, but I cannot help noticing it is Aby.", None), ("The total is 5. It was 6 in 2004. All is fine. I cannot verify the source.", None),
    ],
)
def test_what_is_left_open_and_declined(response, defect):
    assert defect_of(Q, response) == defect


def test_complete_sentences_without_mark():
    assert defect_of("Wer gewann?", "Ajax gewann das Spiel") is None and defect_of("誰が勝ちましたか？", "彼は試合に勝ちました") is None
    assert defect_of("How many towns?", "There are 3 rows, most of them from Febr") == "truncated"


def test_repetitive_texts_take_little_time():
    began = time.perf_counter()
    assert defect_of(Q, " ".join([Q] * 1500)) == "copy"
    assert tiles(["a"] * 10_000, ["a"] * 10_000, 3)[0] == [True] * 10_000
    assert time.perf_counter() - began < 10


def test_tiles_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(2))
        in_a, in_b = tiles(a, b, 3)
        assert sum(in_a) == sum(in_b)
        longest = max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + k] == b[j : j + k]), default=0)
        assert sum(in_a) >= (longest if longest >= 3 else 0) and (longest >= 3 or not any(in_a))
        free = lambda x, used, i: i + 3 <= len(x) and not any(used[i : i + 3])
        left = {tuple(b[j : j + 3]) for j in range(len(b)) if free(b, in_b, j)}
        assert not any(free(a, in_a, i) and tuple(a[i : i + 3]) in left for i in range(len(a)))


def test_pushdown_parser():
    assert inner_stack('{"a": [1, "b\\"', True) == ["{", "[", '"']
    p = parse('```json\n{"a": 1}\n```')
    assert p.is_json and p.value == {"a": 1} and p.open == []
    assert parse("<ul><li>one</li>").open == ["<ul>"]
    assert not breaks_off("A whole sentence.") and breaks_off("A sentence that goes on and")


def test_tiles_take_the_longest_first():
    a, b = "x a b c d y a b".split(), "a b z a b c d".split()
    in_a, in_b = tiles(a, b, 2)
    assert in_a == [False, True, True, True, True, False, True, True] and in_b == [True, True, False, True, True, True, True]


def test_operator(spark):
    rows = [(1, Q, None, "x"), (1, Q, None, "y"), (2, Q, "Aby", "x"), (None, Q, "", "x"), (3, None, "Das ist es.", "x"), (4, Q, Q, None)]
    df = spark.createDataFrame(rows, "result_id bigint, prompt string, raw_output string, defect string")
    assert {tuple(r) for r in response_defects(df).collect()} == {(1, "empty"), (None, "empty"), (4, "copy")}
    assert response_defects(df.limit(0)).count() == 0
    assert {r.defect: r.pairs for r in defect_report(df).collect()} == dict.fromkeys(DEFECTS, 0) | {"empty": 2, "copy": 1}


@pytest.mark.parametrize(
    "question",
    ["どのクラブが1967年に最も多くの観客を集めましたか？", "Welche größten Städte führten früher häufig?", "Où était née l'héritière préférée?"],
)
def test_copy_of_an_escaped_question(question):
    prompt = json.dumps({"task": "answer", "question": question})
    assert "\\u" in prompt and defect_of(prompt, question) == "copy"


def test_copy_of_a_question_beside_kana():
    question = "Which club had the highest turnout in 1967?"
    prompt = json.dumps({"table": "クラブ", "question": question}, ensure_ascii=False)
    assert defect_of(prompt, question) == "copy"
