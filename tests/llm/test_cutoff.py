import json

import pytest

from sievewright.llm import cutoff

WHOLE = 'When it arrives, draw a card.\nHearthspan, oakloom\nChoose a side. Cards cost {2}{R} less while it has oakloom.'


def cards(spark, raws, arm="a"):
    rows = [(i, r, arm, None) for i, r in enumerate(raws)]
    return {r["id"]: r["is_cut"] for r in cutoff.cut_outputs(spark.createDataFrame(rows, "id long, raw string, arm string, flag boolean"), "id", "raw", "arm", "flag").collect()}


@pytest.mark.parametrize(
    "raw, state",
    [
        (None, "none"), ("", "none"), (" \n", "none"), ("\ufeff", "none"),
        ('{"oracle_text": "Draw a card."}', "whole"),
        ('{"oracle_text": "Draw a card.", "rarity": "rare",}', "whole"),
        ("{'oracle_text': 'Draw a card.'}", "whole"),
        ('{oracle_text:"Draw a card.",rarity:"rare"}', "whole"),
        ('```json\n{"oracle_text": "Draw a card."}\n```', "whole"),
        ('```json\n{"oracle_text": "Draw a card."}', "whole"),
        ('{"name": "x", "faces": [{"oracle_text": "Draw a ca"}]}', "whole"),
        ('{"oracle_text": "Draw a ca', "string"),
        ('{"oracle_text": "Draw a card.\\', "escape"),
        ('{"oracle_text": "Draw \\u20', "escape"),
        ('{"oracle_text": "Draw a card."', "bracket"),
        ('{"oracle_text": "Draw a card.", "rarity":', "bracket"),
        ('{', "bracket"), ('```json\n', "bracket"),
        ('{"oracle_text": "Draw a card. It has “Copy this."}', "open"),
        ('{"oracle_text": "Flash (Cast it at any time."}', "open"),
        ('{"oracle_text": "Draw a card for each …"}', "sentence"),
        ('{"oracle_text": "Draw a card for each [...]"}', "sentence"),
        ('{"oracle_text": "Draw a card. …"}', "whole"),
        ('{"oracle_text": "Draw a card,"}', "sentence"),
        ('{"oracle_text": "Draw a card for ea"}', "look"),
        ('{"oracle_text": ""}', "whole"), ('{"oracle_text": null}', "whole"), ("{}", "whole"),
        ("{2}{R}: Draw a card.", "whole"), ("{2}{R}: Draw a c", "look"),
        ("Draw a card�", "character"),
        ('{"oracle_text": "It says \\"stop\\" once."}', "whole"),
    ],
)
def test_states(raw, state):
    assert cutoff.examine(raw, "oracle_text")[0] == state


def test_keyword_lines_are_whole_and_cut_ones_are_not(spark):
    end = lambda last: json.dumps({"oracle_text": "Draw a card for each one.\n" + last})
    got = cards(spark, [json.dumps({"oracle_text": WHOLE}), end("Hearthspan"), end("Hearthsp"), end("Oakloom, hearthspan"), end("Oakloom, hearth"), end("Choose"), end("Draw a card for each side")])
    assert got == {0: False, 1: False, 2: True, 3: False, 4: True, 5: True, 6: True}


def test_a_source_that_never_ends_sentences_is_no_case(spark):
    loose = "a line of several words without end\nand one more line of that kind\nand this is the last"
    assert not any(cards(spark, [loose, loose], "loose").values())


def test_long_repeated_and_absent(spark):
    got = cards(spark, ["{" + '"a":[' * 20_000, '{"oracle_text": "' + "x " * 100_000 + '."}', None])
    assert got == {0: True, 1: False, 2: False}
    empty = spark.createDataFrame([], "id long, raw string, source string, state string, parts string")
    assert cutoff.cut_outputs(empty, "id", "raw", "source").count() == 0
    twice = spark.createDataFrame([(1, "Draw a card.", None), (1, "{", "s")], "id long, raw string, source string")
    assert {r["source"]: r["is_cut"] for r in cutoff.cut_outputs(twice, "id", "raw", "source").collect()} == {None: False, "s": True}


def test_report_counts_blank_outputs_apart(spark):
    df = spark.createDataFrame([(1, "{", "a", True), (2, "{}", "a", True), (3, "", "a", None)], "id long, raw string, arm string, f boolean")
    r = cutoff.cut_report(cutoff.cut_outputs(df, "id", "raw", "arm", "f")).first()
    assert (r["outputs"], r["blank_outputs"], r["cut_outputs"], r["cut_share"], r["flagged_not_cut"]) == (3, 1, 1, 0.5, 1)
