"""Sentence spans: cases, and whole conversation texts against a plain scan by characters."""

import re

import pytest

from lodestone.functions import sentences as SE
from lodestone.functions.text import ABBREVIATIONS
from lodestone.plans import queries
from lodestone.plans._common import table

SF = "/root/testdata/sf0.001"
CASES = [
    ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]), ("It costs $5.50, e.g. here. Next.", ["It costs $5.50, e.g. here.", "Next."]), ('He said "Stop." Then left.', ['He said "Stop."', "Then left."]),
    ("Wait... what? Yes… No.", ["Wait... what?", "Yes…", "No."]), ("See (it ends. Not here!) for more. Done.", ["See (it ends. Not here!) for more.", "Done."]), ("1. First point. 2. Second one.", ["1. First point.", "2. Second one."]), ("Dr. J. Smith vs. Mr. X. came.", ["Dr. J. Smith vs. Mr. X. came."]),
    ("A claim. [3, 7] Another [2]. End", ["A claim. [3, 7]", "Another [2].", "End"]), ("No stop\n\nNew (open\n \nLast.", ["No stop", "New (open", "Last."]), ("", []), (" \n ", []), ("?!", ["?!"]), ("Really?! Yes.", ["Really?!", "Yes."]), ("approx. five. small start.", ["approx. five. small start."]), ("日本語。 Next. Ünder.", ["日本語。 Next.", "Ünder."]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    assert [text[a:b] for a, b in SE.spans(text)] == want


def plain(text):
    """Every end mark is judged by what stands around it, character by character."""
    out = []
    for para in re.split(r"\s*\n\s*\n\s*", text):
        begin, depth, i, n = None, 0, 0, len(para)
        while i < n:
            c = para[i]
            if c.isspace():
                i += 1
                continue
            if begin is None:
                begin = i
                if m := re.match(r"\d+[.)](?=\s)", para[i:]):
                    i += m.end()
                    continue
            if cite := re.match(r"\[\d+(?:\s*,\s*\d+)*\]", para[i:]):
                i += cite.end()
                continue
            depth = depth + 1 if c in "([{" else max(0, depth - 1) if c in ")]}" else depth
            if c not in ".!?…":
                i += 1
                continue
            j = i
            while j < n and para[j] in ".!?…":
                j += 1
            mark = para[i:j]
            alone, inner = not re.match(r"\w", para[i + 1 :]) and c == ".", depth > 0
            short = [a for a in [*ABBREVIATIONS, para[i - 1 : i]] if a and para[:i].endswith(a) and re.match(r"[^\W\d_]", a) and not re.match(r"\w", para[i - len(a) - 1 : i - len(a)] if i > len(a) else "")]
            if alone and short:
                i += 1
                mark = para[i:j]
                if not mark:
                    continue
            k = j
            while m := re.match(r"[)\]}\"'”’»]|\s*\[\d+(?:\s*,\s*\d+)*\]", para[k:]):
                depth = max(0, depth - 1) if m[0] in ")]}" else depth
                k += m.end()
            rest = para[k:].lstrip()
            if (rest and len(rest) == n - k) or depth or (rest and rest[0].islower() and (inner or mark in (".", "...") or mark[0] == "…")):
                i = k
                continue
            out.append(para[begin:k])
            begin, i = None, k
        if begin is not None:
            out.append(para[begin:].rstrip())
    return out


def test_whole_texts(spark):
    got = {(r.conv_id, r.turn): r.sentences for r in queries()["conversation_sentences"](spark, SF).collect()}
    rows = [r for r in table(spark, SF, "conversations").collect() if r.text is not None]
    assert sum(len(got[r.conv_id, r.turn]) for r in rows) > len(rows)
    for r in rows:
        assert got[r.conv_id, r.turn] == plain(r.text), r.text
