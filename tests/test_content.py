"""Main content: planted pages, and all pages against a plain version."""

import hashlib
import re
from html import unescape

from pyspark.sql import functions as F

from lodestone.plans import queries
from lodestone.plans._common import table
from lodestone.sources import content as CO

SF = "/root/testdata/sf0.001"
PROSE = "A sentence of the article with quite a few words in it, so that it counts as prose and not as a label. "


def plain(html):
    """The same rules over a list of tokens, with marks for the ends of blocks."""
    stack, flow = [], []
    html = re.sub(r"(?s)<!--.*?-->|<![^>]*>", "", html)
    raw = None
    for token in re.findall(r"<[^>]*>|[^<]+", html):
        m = re.match(r"<(/?)([a-zA-Z0-9]+)", token)
        if raw:  # in script and style only the end tag counts
            if not (m and m[1] and m[2].lower() == raw):
                continue
            raw = None
        if not m:
            if not any(t in CO.OUT for t in stack):
                flow.append((unescape(token), "a" in stack, any(t in CO.HEADINGS for t in stack)))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in stack:
                closed = stack[len(stack) - 1 - stack[::-1].index(tag) :]
                if any(t in CO.BLOCK or t in CO.OUT for t in closed):
                    flow.append(None)
                del stack[len(stack) - len(closed) :]
        else:
            if tag in CO.BLOCK or tag in CO.OUT:
                flow.append(None)
            if tag not in CO.VOID and not token.endswith("/>"):
                stack.append(tag)
                raw = tag if tag in ("script", "style") else None
    out, now = [], []
    for x in [*flow, None]:
        if x is None:
            words = "".join(t for t, _, _ in now).split()
            if words:
                out.append((" ".join(words), len(words), len("".join(t if a else " " for t, a, _ in now).split()), any(h for _, _, h in now)))
            now = []
        else:
            now.append(x)
    kept, head = [], None
    for i, (text, n, linked, heading) in enumerate(out):
        if heading:
            head = text if linked * 3 <= n else None
            continue
        p, q = (out[i - 1] if i else ("", 0, 0)), (out[i + 1] if i + 1 < len(out) else ("", 0, 0))
        good = linked / n <= 1 / 3 and ((n > 16 or q[1] > 15 or p[1] > 4) if p[2] * 9 <= 5 * p[1] else (n > 40 or q[1] > 17))
        if good:
            kept += [head] * (head is not None) + [text]
            head = None
    return "\n".join(kept), len(out), len(kept)


def test_planted(spark):
    links = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(8))
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><div class=menu><ul>{links}</ul></div><h1>The title</h1><p>{PROSE * 2}</p><p>{PROSE}<a href=y>one link</a> inside.</p><h2>Related</h2><ul>{links}</ul><h2>More</h2><p>{PROSE}</p><form><p>{PROSE}</p></form><aside>{PROSE}</aside><footer>&copy; {PROSE}</footer><script>var t='<p>{PROSE}</p>';</script></body></html>"
    text = CO.main_text(page)
    once = " ".join(PROSE.split())
    assert text == "\n".join(["The title", " ".join((PROSE * 2).split()), f"{once} one link inside.", "More", once])
    rows = [(1, page), (2, None), (3, ""), (4, "<p>short</p>"), (5, "no tags at all"), (6, f"<div><p>{PROSE}<b>bold</p></div></span>{PROSE}"), (7, f"<p>{PROSE * 5000}</p>")]
    got = {r.k: r for r in CO.with_content(spark.createDataFrame(rows, "k int, html string").withColumn("extra", F.lit(1))).collect()}
    assert got[1].content == text and got[2].content is None and got[2].blocks is None and got[3].content == "" and got[3].kept == 0 and got[4].content == "" and got[5].kept == 0 and got[6].kept == 2 and len(got[7].content) > 400_000
    assert {r.k: r.c for r in spark.createDataFrame(rows, "k int, html string").select("k", CO.content("html").alias("c")).collect()} == {k: r.content for k, r in got.items()}
    assert CO.with_content(spark.createDataFrame([], "html string")).count() == 0


def test_all_pages(spark):
    got = {r.page_id: (r.content_hash, r.blocks, r.kept) for r in queries()["main_content"](spark, SF).collect()}
    dropped = 0
    for r in table(spark, SF, "pages").collect():
        if r.html is None:
            assert got[r.page_id] == (None, None, None)
            continue
        text, n, kept = plain(r.html)
        assert got[r.page_id] == (hashlib.sha256(text.encode()).hexdigest(), n, kept), r.page_id
        dropped += n - kept
    assert dropped > 0
