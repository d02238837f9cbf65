"""The text operators against libraries, brute force and round trips, with the cases their docstrings state."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from factloom.llm import chat, components, decontaminate, exchange, html_text, jaccard, lm, media, pii, sentencepieces, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, held_out int, score string"
WORDS = "the of and tree river stone light music paper window garden winter summer copper silver".split()


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, None, None, None, 1, "x") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(5)
    letters = "ab  ▁▁\n\t\x1c\x85é中🙂<|endoftext|>'s't12.,!thein 　\x0b</s>[INST]\\"
    texts = [None, "", " ", "\n", "one", "one two three four five six", "x" * 5000, "▁" * 70, "the " * 900, "<|endoftext|>x<|endoftext|>", "\\l\\b<s>", "a\\"]
    return texts + ["".join(r.choice(letters) for _ in range(r.randint(1, 200))) for _ in range(120)]


def test_token_counts_follow_the_library(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(token_counts.default_vocabulary())
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, odd)).collect()}
    for i, text in enumerate(odd):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 512)


def test_pieces_follow_the_library_and_come_back(spark, odd):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepieces.default_model())
    ids = sentencepieces.encode_pieces(frame(spark, odd))
    got = {r.doc_id: list(r.ids) for r in ids.collect()}
    assert [got[i] for i in range(len(odd))] == [sp.encode(t or "") for t in odd]
    back = {r.doc_id: r.text for r in sentencepieces.decode_pieces(ids).collect()}
    for i, text in enumerate(odd):
        assert back[i] == (text or "").replace("▁", " ")


def test_pieces_of_a_stream_do_not_depend_on_its_blocks():
    c = sentencepieces.codec(sentencepieces.default_model())
    text = "▁inthe" * 200 + "x" * 300
    whole = list(c.segments((text,)))
    r, at, blocks = random.Random(1), 0, []
    while at < len(text):
        n = r.randint(1, 9)
        blocks.append(text[at : at + n])
        at += n
    assert list(c.segments(blocks)) == whole


def _components(sets, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def _near_copies(seed, groups=6, size=14):
    r, texts = random.Random(seed), []
    passage = " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(60))
    for _ in range(groups):
        base = [r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(r.randint(4, 140))]
        for _ in range(r.randint(1, size)):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 40))):
                words[r.randrange(len(words))] = f"edit{r.randint(0, 9999)}"
            texts.append(" ".join(words) + (" " + passage if r.random() < 0.3 else ""))
    texts += ["", None, "one two", "ONE  two", "one two three"] + texts[:3]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "family", "wide"), [(1, 3, 6), (2, 3, 1000), (3, 512, 512)])
def test_jaccard_groups_are_those_of_all_pairs(spark, seed, family, wide, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "FAMILY", family)
    monkeypatch.setattr(jaccard, "WIDE", wide)
    texts = _near_copies(seed)
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    want = _components(sets, list(sets))
    got = {r.doc_id: r for r in jaccard.jaccard_groups(frame(spark, texts)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    kept = {r.doc_id for r in jaccard.keep_one(frame(spark, texts)).collect()}
    assert kept == set(want.values())


def test_one_id_by_several_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, a), (5, b), (7, a + " more"), (9, b + " more"), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in jaccard.jaccard_groups(df).collect())
    assert got == [(0, 5), (5, 5), (5, 5), (7, 5), (9, 5)]


def test_divide_skip_finds_what_counting_finds():
    r = random.Random(3)
    for _ in range(30):
        sets = [np.array(sorted(r.sample(range(40), r.randint(3, 30))), np.uint64) for _ in range(25)]
        index = jaccard.InvertedIndex(sets, [len(s) for s in sets])
        for q in sets[:5]:
            got = index.search(q, len(q), lambda i: True)
            assert got == [i for i, s in enumerate(sets) if jaccard.linked(len(np.intersect1d(q, s)), len(q), len(s))]


def test_join_block_joins_groups_that_only_a_middle_set_links():
    base = np.arange(100, dtype=np.uint64)
    sets = [base, base + np.uint64(8), base + np.uint64(16), base + np.uint64(500)]
    edges = jaccard.join_block([1, 2, 3, 4], [100] * 4, sets, [1, 2, 3, 4])
    assert {frozenset(e) for e in edges} == {frozenset((1, 2)), frozenset((2, 3))}


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert jaccard.jaccard_groups(docs).count() == 0
    assert lm.score(docs).count() == 0
    assert token_counts.count_tokens(docs).count() == 0
    assert pii.detect(docs).count() == 0
    assert media.media_features(docs).count() == 0
    assert decontaminate.contained(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert chat.digest(chat.expand_prefix_targets(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string"), weights=html_text.new_weights(1)).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    live = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root[n] for n in live}


def test_packing_round_trips():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 1000):
        keys = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        assert (exchange.unpack_sorted(exchange.pack_sorted(keys)) == keys).all()
        for top in (1, 200, 70_000, 2**40):
            counts = r.integers(0, top + 1, n)
            assert (exchange.unpack_counts(exchange.pack_counts(counts), n) == counts).all()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_base_spans_are_those_of_the_patterns(spark, odd):
    r = random.Random(8)
    parts = ["a@b.c", "@", "x.y@z", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (743) 555-3824", "+", "5", ".", " ", "-", "é", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "00004.3.2.1", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(300)] + odd
    got = {x.doc_id: x for x in pii.detect(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if pii.valid(k, m.group())]
        assert got[i].base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest(), t
        assert {s for s in pii.joined(want).split(",") if s} <= set(got[i].spans.split(","))


def test_the_field_adds_forms_that_the_patterns_miss_and_masks_them(spark):
    text = 'Call (743) 555-3824 now, the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" is ours, mail ann@x.example.com; 250 people in 1998.'
    rows = pii.detect(frame(spark, [text])).collect()
    assert "phone:5:19" in rows[0].spans and "secret:" in rows[0].spans and rows[0].n_email == 1 and rows[0].n_phone == 0
    out = pii.mask(frame(spark, [text, None, "plain words"]), length="n_chars").orderBy("doc_id").collect()
    assert out[0].text == 'Call <phone> now, the token = "<secret>" is ours, mail <email>; 250 people in 1998.'
    assert out[0].n_chars == len(out[0].text) and out[1].text is None and out[2].text == "plain words" and out[0].score == "x"


def test_viterbi_of_stretches_is_viterbi_of_the_whole():
    f = pii.field()
    words = 'the of and 555 (743) 555-3824 in is token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" that it a@b.com 4111 1111 1111 1111 the'.split()
    scores = f.scores(words)
    whole = f.viterbi([(scores, False, False)])[0]
    cut = np.zeros(len(words), int)
    for a, b in f.stretches(scores):
        cut[a:b] = f.viterbi([(scores[a:b], a > 0, b < len(words))])[0]
    assert (whole == cut).all() and whole.any()


def test_media_payloads_come_back(spark, odd):
    got = {r.doc_id: r for r in media.media_features(frame(spark, odd)).collect()}
    stored = {r.doc_id: bytes(r.media) for r in media.store_media(frame(spark, odd)).collect()}
    for i, t in enumerate(odd):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_sha256 == hashlib.sha256(stored[i]).hexdigest() and r.media_bytes == len(stored[i])
        assert media.read_payload(stored[i]) == payload
    assert len({r.feature.split(":")[0] for r in got.values()}) == 3
    pcm = media.to_pcm(media.store_media(frame(spark, ["abc"]), codec="mulaw")).first().pcm
    assert media.parse_wave(bytes(pcm))[:2] == ("pcm", 16000)


def test_adpcm_blocks_are_decoded_as_one_by_one():
    r = np.random.default_rng(1)
    blocks = r.integers(0, 256, (7, media.BLOCK)).astype(np.uint8)
    got = media.adpcm_pcm(blocks)
    for row, block in zip(got, blocks, strict=True):
        value = int(np.frombuffer(block[:2].tobytes(), "<i2")[0])
        index, want = min(int(block[2]), 88), [value]
        for byte in block[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = int(media.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(media.INDEX_STEPS[code & 7])))
                want.append(value)
        assert row.tolist() == want


def test_decontamination_finds_short_items_in_long_documents(spark):
    r = random.Random(9)
    item = " ".join(f"w{k}" for k in range(40))
    noise = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 10**6)) for _ in range(n))
    words = item.upper().split()
    docs = [noise(500) + " " + item + " " + noise(500), item, " ".join(words[:35]), " ".join(words[:20]), noise(300), None, "", "w0 w1", item + " " + item]
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "w0 w1"), (5, "w0  W1")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contained(frame(spark, docs), items).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (7, 4), (7, 5), (8, 1)}
    left = decontaminate.clean(frame(spark, docs), items)
    assert sorted(x.doc_id for x in left.collect()) == [3, 4, 5, 6] and left.columns == frame(spark, docs).columns


def test_chat_examples_read_back(spark):
    rows = [
        (1, 0, "system", "be </s> kind"), (1, 1, "user", "[INST] hi \\ there"), (1, 2, "assistant", "hello <|x|>"), (1, 3, "user", None), (1, 4, "assistant", ""),
        (2, 0, "user", "only a question"), (3, 0, "assistant", "only a reply"), (3, 0, "assistant", "only a reply"), (4, 0, None, "x</s>"), (None, 0, "user", "lost"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.expand_prefix_targets(df)
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {(r.conv_id, r.example) for r in examples.where("target is not null").collect()} == {(1, 2), (1, 4), (3, 0), (3, 1)}


def test_lm_scores_by_brute_force_counts(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 40))) for _ in range(80)] + [None, "", "UNSEEN words"]
    got = {x.doc_id: x for x in lm.score(frame(spark, texts)).collect()}
    counts, pairs, toks = {}, {}, {}
    for i, t in enumerate(texts):
        toks[i] = re.findall("[^ \t-\r]+", (t or "").lower()) + [None]
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for a, b in zip([0, *toks[i]], toks[i], strict=False):
                counts[b] = counts.get(b, 0) + 1
                pairs[a, b] = pairs.get((a, b), 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, w in toks.items():
        base = sum(np.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert abs(got[i].base_score - base) < 1e-9 * max(1, abs(base)) and got[i].train_tokens == n and got[i].n_tokens == len(w)
        assert got[i].n_known == sum(x in counts for x in w) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert got[i].score < 0


def test_em_weights_raise_the_likelihood_and_sum_to_one():
    class Row:
        def __init__(self, cell, k, p2, p1):
            self.cell, self.k, self.p2, self.p1 = cell, k, p2 * k, p1 * k

    base = (lm.CELLS + 1) ** 2
    w = lm.learn_weights([Row(3 * base + 5, 100, 0.4, 0.01), Row(3 * base + 9, 10, 0.0, 0.02)], 1000)
    assert np.allclose(w.sum(axis=1), 1) and w[3][0] > lm.PRIOR[0] and np.allclose(w[9], w[3], atol=1e-6)


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(6)
    texts, labels = [], []
    for i in range(600):
        words = [r.choice(WORDS) for _ in range(r.randint(5, 40))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grobly", "snark", "vexing!"]))
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    docs = frame(spark, [*texts, None, ""])
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got.values()) and got[600].score == got[601].score
    tagged = toxicity.tag(docs, model)
    assert {x.doc_id: x["__toxic"] for x in tagged.collect()} == {i: x.predicted for i, x in got.items()}


def test_html_text(spark):
    page = '<html><head><title>T</title><script>x("<p>no</p>")</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav><!-- no --><div class="ad">Buy this now.</div><article><h1>A &amp; B</h1><p><b>First line.<br><p>Second  par&#233;\n line with words and more words.</p></article><footer>&copy; some site</footer></body></html>'
    rows = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, "w", ""), (4, None, "<p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(rows).collect()}
    assert got[1].text == "A & B\nFirst line.\nSecond paré line with words and more words." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == got[4].text == "" and got[4].url is None


def test_block_labels_on_generated_pages():
    writer, wrong, total = html_text.PageWriter(77), 0, 0
    made = [p for p in (writer.page() for _ in range(60)) if p[0]]
    for mark, (_, labels) in zip(html_text.main_blocks(html_text.train(), [html_text.vectors(b) for b, _ in made]), made, strict=True):
        wrong += int((mark != np.array(labels, bool)).sum())
        total += len(labels)
    assert wrong <= 0.03 * total


def test_lstm_gradients_are_those_of_differences():
    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in html_text.new_weights(3).items()}
    x = r.normal(size=(4, 2, html_text.INPUT))
    live = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    pull = r.normal(size=(4, 2, html_text.HIDDEN)) * live[..., None]
    loss = lambda: float((html_text.run_lstm(w, "fore", x, live).astype(np.float64) * pull).sum())
    _, tape = html_text.run_lstm(w, "fore", x, live, keep=True)
    g = html_text.lstm_gradients(w, "fore", x, live, tape, pull)
    for name in ("fore_x", "fore_h", "fore_b"):
        at = tuple(0 for _ in w[name].shape)
        old = w[name][at]
        w[name][at] = old + 0.05
        high = loss()
        w[name][at] = old - 0.05
        low = loss()
        w[name][at] = old
        assert abs((high - low) / 0.1 - g[name][at]) < 0.02 * max(1, abs(g[name][at]))
