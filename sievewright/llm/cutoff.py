"""Texts that lost their end (problem 4).

A stack automaton follows strings, brackets and escapes of an output and tells whether its object is finished.
The end of its text must then be a terminator with nothing left open, unless the last line is one of keywords:
those are learned from the lines that are followed by another, which are complete for certain, and from words
inside sentences that never begin one. How often complete lines lack a terminator is the baseline of a source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.splits import HOT_SHARE, spread_join
from sievewright.sources.shared import materialize

FENCE = re.compile(r"```[\w+-]*[ \t]*\r?\n?")
SYMBOL = re.compile(r"\{[0-9A-Z/]{1,7}\}")
TOKEN = re.compile(r"[{}\[\]\"']")
STRINGS = {'"': re.compile(r'"((?:[^"\\]|\\.)*)"', re.S), "'": re.compile(r"'((?:[^'\\]|\\.)*)'", re.S)}
ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
OMISSION = re.compile(r"(?:\s*(?:\[(?:\.\.\.|…)\]|\((?:\.\.\.|…)\)|\.\.\.|…))+\s*$")
OPENERS = {"(": ")", "“": "”", "[": "]"}
CLOSERS = set(OPENERS.values())
ENDS = ".!?。"
AFTER_END = ")”\"’'»]"
WORD = re.compile(r"[^\W\d_]+")
#: Evidence that a task has sent is sent once, as long as so many pieces fit.
SENT = 500_000


def automaton(body: str, name: str) -> tuple[str, str | None]:
    """Follow the object at the start of `body`: (state, text of its member `name`).

    state is 'closed', or what was left open at the end: 'string', 'escape', 'bracket'.
    """
    stack, at, key, text = [], 0, None, None
    while True:
        m = TOKEN.search(body, at)
        if not m:
            return "bracket", text
        ch, at = m.group(), m.end()
        if ch in "{[":
            stack.append(ch)
        elif ch in "}]":
            if stack and (stack[-1] == "{") == (ch == "}"):
                stack.pop()
            if not stack:
                return "closed", text
        else:
            before = body[: m.start()].rstrip()[-1:] if m.start() < 64 else body[m.start() - 64 : m.start()].rstrip()[-1:]
            if before not in ("{", "[", ",", ":"):
                continue  # a quote that begins no string
            s = STRINGS[ch].match(body, m.start())
            if not s:
                return ("escape" if re.search(r"\\(?:u[0-9a-fA-F]{0,3})?$", body) else "string"), text
            if before == ":":
                named = key if key is not None else re.search(r"([A-Za-z_]\w*)\s*:\s*$", body[max(0, m.start() - 64) : m.start()])
                if len(stack) == 1 and (named if isinstance(named, str) else named and named.group(1)) == name:
                    text = ESCAPE.sub(lambda e: chr(int(e[1][1:], 16)) if len(e[1]) == 5 else ESCAPED.get(e[1], e[1]), s.group(1))
                key = None
            else:
                key = s.group(1) if re.match(r"\s*:", body[s.end() : s.end() + 8]) else None
            at = s.end()


def left_open(line: str) -> bool:
    """Whether a bracket or curly quote of the line is not closed."""
    stack = []
    for ch in line:
        if ch in OPENERS:
            stack.append(OPENERS[ch])
        elif ch in CLOSERS and ch in stack:
            while stack.pop() != ch:
                pass
    return bool(stack)


def ended(line: str) -> bool:
    """Whether a line ends with a terminator, perhaps inside closing brackets or quotes."""
    return line.rstrip(AFTER_END)[-1:] in tuple(ENDS) and bool(line.rstrip(AFTER_END))


def keywords(line: str) -> list[str]:
    """The parts by which a line without a full stop is known: its words for a type line, else its list members."""
    if " — " in line:
        return ["t:" + w for w in line.lower().split()]
    return ["k:" + p.strip().lower() for p in line.split(",")]


def evidence(lines: list[str]) -> set[str]:
    """Keyword parts (k:, t:) of complete lines without an end, first words (o:) and inner words (w:) of sentences."""
    found = {p for x in lines[:-1] if not ended(x) for p in keywords(x)}
    for i, line in enumerate(lines):
        ws = WORD.findall(line)
        if len(ws) > 2 and line.count(",") < len(ws) - 1:
            found.update("w:" + w for w in (ws[1:-1] if i == len(lines) - 1 else ws[1:]))
            if line[0].isalpha() and not line[len(ws[0]) : len(ws[0]) + 2].strip(" ").isdigit():
                found.add("o:" + ws[0].lower())
    return found


def examine(raw: str | None, name: str) -> tuple[str, list[str], set[str], int, int]:
    """(state, parts of the last line to look up, evidence, earlier lines, those without end that are long).

    state: 'none' (blank), 'whole', 'look' (the last line has no terminator) or why the output is cut.
    """
    body = (raw or "").strip().lstrip("\ufeff").lstrip()
    if not body:
        return "none", [], set(), 0, 0
    if f := FENCE.match(body):
        body = body[f.end() :]
        close = body.rfind("```")
        body = (body[:close] if close >= 0 else body.rstrip("`")).strip()
        if not body:
            return ("whole" if close >= 0 else "bracket"), [], set(), 0, 0
    text = body
    state = "closed"
    if body[0] == "{" and not SYMBOL.match(body):
        state, text = automaton(body, name)
        if state == "closed" and text is None:
            return "whole", [], set(), 0, 0
    lines = [x.strip() for x in (text or "").split("\n")]
    lines = [x for x in lines if x]
    before = lines[:-1]
    loose = [x for x in before if not ended(x) and len(WORD.findall(x)) > x.count(",") + 2 and " — " not in x]
    seen = evidence(lines)
    if state != "closed":
        return state, [], seen, len(before), len(loose)
    bare = OMISSION.sub("", text.rstrip())
    last = bare.rstrip().split("\n")[-1].strip()
    if not last:
        return "whole", [], seen, len(before), len(loose)
    if last[-1] == "�" or 0xD800 <= ord(last[-1]) <= 0xDFFF:
        return "character", [], seen, len(before), len(loose)
    if last[-1] == "\\":
        return "escape", [], seen, len(before), len(loose)
    if ended(last):
        return ("open" if left_open(last) else "whole"), [], seen, len(before), len(loose)
    if bare != text.rstrip() or left_open(last) or not last[-1].isalnum():
        return "sentence", [], seen, len(before), len(loose)
    return "look", sorted(set(keywords(last))), seen, len(before), len(loose)


def cut_outputs(df: DataFrame, id_col: str, raw_col: str, source_col: str, flag_col: str | None = None, text_name: str = "oracle_text", usual: float = 0.5) -> DataFrame:
    """Each row of `df` with `is_cut`, the reason, its source and flag: (`id`, `source`, `flag`, `is_blank`, `reason`, `is_cut`, `ends_untold`).

    Null, empty and blank texts are no case. A last line without terminator is whole if each of its parts is known as
    a keyword from any row. Where more than `usual` of a source's complete lines are sentences that
    lack a terminator, a missing one says nothing about that source (`ends_untold`). Rows that repeat an id are judged together:
    one is cut if any is.
    """

    @F.pandas_udf("state string, parts array<string>, seen array<string>, n int, loose int")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sent: set[str] = set()
        for raws in batches:
            made = []
            for raw in raws:
                state, parts, seen, n, loose = examine(raw, text_name)
                made.append((state, parts, list(seen - sent), n, loose))
                sent |= seen
            if len(sent) > SENT:
                sent.clear()
            yield pd.DataFrame(made, columns=["state", "parts", "seen", "n", "loose"])

    flag = F.col(flag_col).cast("boolean") if flag_col else F.lit(None).cast("boolean")
    scanned = materialize(
        df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), flag.alias("flag"), scan(raw_col).alias("s")).select("id", "source", "flag", "s.*"),
        "cutoff",
    )
    kind, word = F.substring("part", 1, 1), F.substring("part", 3, 1 << 30)
    has = lambda k: F.max(F.col("kind") == k).alias(k)
    known = scanned.select(F.explode("seen").alias("part")).select(kind.alias("kind"), word.alias("word")).groupBy("word").agg(*map(has, "ktwo"))
    asked = scanned.filter("state = 'look'").select("id", F.explode("parts").alias("part")).select("id", kind.alias("kind"), word.alias("word"))
    found = F.when(F.col("kind") == "t", F.col("t")).otherwise(F.col("k") | (F.col("w") & ~F.col("o")))
    bound = F.lit(scanned.filter("state = 'look'").count() * HOT_SHARE)
    hot = materialize(asked.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound).select("word"), "hot")
    told = spread_join(asked, materialize(known, "known"), "word", hot)
    unknown = told.filter(~F.coalesce(found, F.lit(False))).groupBy("id").agg(F.lit("sentence").alias("missing"))
    baseline = scanned.groupBy("source").agg(F.try_divide(F.sum("loose"), F.sum("n")).alias("loose_share")).withColumnRenamed("source", "s2")
    judged = scanned.join(unknown, "id", "left").join(baseline, F.col("source").eqNullSafe(F.col("s2")), "left")
    lacking = F.col("missing").isNotNull() & ~(F.coalesce(F.col("loose_share"), F.lit(0.0)) > usual)
    reason = F.when(F.col("state").isin("none", "whole"), None).when(F.col("state") != "look", F.col("state")).when(lacking, F.lit("sentence"))
    silent = F.coalesce(F.col("loose_share"), F.lit(0.0)) > usual
    return judged.select("id", "source", "flag", (F.col("state") == "none").alias("is_blank"), reason.alias("reason"), reason.isNotNull().alias("is_cut"), silent.alias("ends_untold"))


def cut_report(judged: DataFrame) -> DataFrame:
    """Per source: outputs, cut ones, their share, how the flag agrees, and whether missing terminators told nothing. Blank outputs are counted apart."""
    told = F.coalesce(F.col("flag"), F.lit(False))
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("outputs"),
        F.count_if("is_blank").alias("blank_outputs"),
        F.count_if("is_cut").alias("cut_outputs"),
        F.round(F.try_divide(F.count_if("is_cut"), F.count_if(~F.col("is_blank"))), 6).alias("cut_share"),
        F.count_if(F.col("is_cut") & ~told).alias("cut_not_flagged"),
        F.count_if(~F.col("is_cut") & told).alias("flagged_not_cut"),
        F.bool_or("ends_untold").alias("ends_untold"),
    )
