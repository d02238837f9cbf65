"""The block labeller's forward pass by brute force, long pages, page order, repeated rows and clashing columns."""

import math

import numpy as np

from factloom.llm import html_text as H


def brute_logits(w, x):
    """Logits of one page's blocks, gate by gate in plain Python."""
    sig = lambda v: 1 / (1 + math.exp(-max(-30, min(30, v))))

    def states(side, rows):
        h, c, out = [0.0] * H.HIDDEN, [0.0] * H.HIDDEN, []
        for row in rows:
            z = [float(w[f"{side}_b"][k]) + sum(float(row[i]) * float(w[f"{side}_x"][i][k]) for i in range(H.INPUT) if row[i]) + sum(h[i] * float(w[f"{side}_h"][i][k]) for i in range(H.HIDDEN)) for k in range(4 * H.HIDDEN)]
            i, f, o, g = (z[k * H.HIDDEN : (k + 1) * H.HIDDEN] for k in range(4))
            c = [sig(f[k]) * c[k] + sig(i[k]) * math.tanh(g[k]) for k in range(H.HIDDEN)]
            h = [sig(o[k]) * math.tanh(c[k]) for k in range(H.HIDDEN)]
            out.append(h)
        return out

    fore, back = states("fore", x), states("back", x[::-1])[::-1]
    return [sum(a * float(b) for a, b in zip(f + g, w["out"], strict=True)) + sum(float(r[i]) * float(w["skip"][i]) for i in range(H.INPUT)) + float(w["base"][0]) for f, g, r in zip(fore, back, x, strict=True)]


def test_both_directions_by_brute_force():
    w = H.new_weights(9)
    writer = H.PageWriter(5)
    pages = [H.vectors(p[0]) for p in (writer.page() for _ in range(4)) if p[0]]
    z, live = H.logits(w, pages)
    for n, x in enumerate(pages):
        assert np.allclose(z[: len(x), n], brute_logits(w, x), atol=1e-4) and live[:, n].sum() == len(x)


def test_long_pages_go_in_slabs(monkeypatch):
    w, writer = H.train(), H.PageWriter(15)
    found = [writer.page()[0] for _ in range(12)] + [[]]
    whole = H.label_pages(w, found)
    for size in (1, 5, 16):
        monkeypatch.setattr(H, "BLOCKS_AT_ONCE", size)
        assert all((a == b).all() for a, b in zip(H.label_pages(w, found), whole, strict=True))


def test_a_page_of_megabytes_and_rows_as_they_are(spark):
    body = "".join(f"<p>Paragraph {k} of a long story, with a few more words in it.</p>" for k in range(40_000))
    page = f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Story</h1>{body}</article><footer>&copy; site</footer></body></html>"
    assert len(page) > 2_000_000
    rows = [(1, "u", page, 5), (2, "v", "<article><p>Some words here, and some more of them.</p></article>", 6), (2, "v", "<article><p>Some words here, and some more of them.</p></article>", 6), (None, None, None, None)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(got) == 4 and got[1] == got[2] and got[1].text == "Some words here, and some more of them." and got[3].text == ""
    lines = got[0].text.split("\n")
    assert sum(x.startswith("Paragraph") for x in lines) >= 39_900 and "Home" not in lines[0] and got[0].n_chars == len(got[0].text)
