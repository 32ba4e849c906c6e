import base64
import itertools
import os
import random
import tracemalloc

import numpy as np
import pytest

from sedgeline.llm import leaks, spam
from sedgeline.llm.leaks import leaked_items, leaked_passages
from sedgeline.llm.prefix_bpe import SPLIT_PATTERN, PrefixEncoder, PrefixText, encode_corpus, read_ranks
from sedgeline.llm.spam import fit_pages, list_pages, page_shares

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
SOUP = ["a", "B", "e", "'", "'s", " ", "  ", "\n", "\t", "ü", "ñ", "漢", "字", "😀", "　", "‍", "0", "12", ".", "!?", "<|endoftext|>", "the", " cat", "don't"]


@pytest.fixture(scope="module")
def encoder():
    return PrefixEncoder(read_ranks(open(VOCABULARY, "rb").read()))


@pytest.fixture(scope="module")
def oracle():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def soup(rng, n):
    return "".join(rng.choice(SOUP) for _ in range(rng.randrange(n)))


@needs_vocabulary
def test_ids(encoder, oracle):
    rng = random.Random(1)
    texts = [soup(rng, 60) for _ in range(800)] + ["a" * 5000, " " * 3000, "ACGT" * 2000, "\x00﻿"]
    assert all(encoder.encode(t) == oracle.encode_ordinary(t) for t in texts)
    assert encoder.encode(None) == encoder.encode("") == []


@needs_vocabulary
def test_many_edits(encoder, oracle):
    """EDITS edits, each against a fresh encoding. Further ones by the environment's number."""
    rng = random.Random(9)
    edits = int(os.environ.get("SEDGELINE_EDITS", "100000"))
    soup = ["'", "r", "e", "l", "v", "s", "t", " ", "  ", "\n", "\n\n", "\t", "b", "1", " a", "!", "\u3000", "é", "the", " cat"]
    p = PrefixText(encoder)
    for k in range(edits):
        text = p.text
        new = "".join(rng.choice(soup) for _ in range(rng.randrange(4)))
        if k % 4 == 0:
            p.append(new)
            assert p.text == text + new
        else:
            i = rng.randrange(len(text) + 1)
            j = rng.randrange(i, min(len(text), i + 5) + 1)
            p.replace(i, j, new)
            assert p.text == text[:i] + new + text[j:]
        assert p.ids() == oracle.encode_ordinary(p.text), (text, new)
        if len(p.text) > 40:
            p = PrefixText(encoder)
    p = PrefixText(encoder, "\n'\n\nb' \n1")
    p.replace(4, 8, " a")
    assert p.ids() == oracle.encode_ordinary(p.text)
    p = PrefixText(encoder, "'r")
    p.append("e")
    assert p.ids() == oracle.encode_ordinary("'re")


@needs_vocabulary
def test_appends_and_edits(encoder, oracle):
    rng = random.Random(2)
    for _ in range(200):
        p, text = PrefixText(encoder), ""
        for _ in range(rng.randrange(6)):
            more = soup(rng, 8)
            p.append(more)
            text += more
            assert p.ids() == oracle.encode_ordinary(text)
        for _ in range(3):
            i = rng.randrange(len(text) + 1)
            j, new = rng.randrange(i, min(len(text), i + 6) + 1), soup(rng, 5)
            p.replace(i, j, new)
            text = text[:i] + new + text[j:]
            assert p.text == text and p.ids() == oracle.encode_ordinary(text)
    p = PrefixText(encoder, "one two three " * 200)
    assert p.replace(5, 6, "x") < 5


@needs_vocabulary
def test_corpus(spark, oracle):
    rows = [(1, "Hello  world", "k"), (2, None, "k"), (3, "", None), (3, "", None), (None, "x" * 40_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = encode_corpus(df, "text", VOCABULARY, keep=["doc_id"])
    assert found.columns == ["doc_id", "ids"] and dict(found.dtypes)["ids"] == "array<int>"
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in found.collect()) == sorted((i or 0, oracle.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert encode_corpus(df.limit(0), "text", VOCABULARY).count() == 0


def words(t):
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in t or "").split()


def test_leaks(spark):
    rng = random.Random(5)
    lexicon = ["w%d" % i for i in range(30)]
    items = [(i, " ".join(rng.choice(lexicon) for _ in range(rng.randrange(8, 40))), "t") for i in range(20)] + [(90, None, "t"), (91, "", "t"), (None, "a b c d e f g h i j k l m", "t")]
    docs = []
    for d in range(150):
        text = [rng.choice(lexicon) for _ in range(rng.randrange(60))]
        if d % 3 == 0:
            w = words(rng.choice(items[:20])[1])
            k = rng.randrange(len(w))
            text[10:10] = w[k : k + rng.choice([10, 11, 12, 13, 30])]
        docs.append((d, rng.choice([" ", ", ", " ", "\n--"]).join(x.upper() if rng.random() < 0.3 else x for x in text), 1, 2))
    docs += [(500, None, 1, 2), (501, "", 1, 2), docs[0], (None, docs[0][1], 1, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int, h int")
    i = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    gram = lambda t: {tuple(w[k : k + 12]) for w in [words(t)] for k in range(len(w) - 11)}
    expected = sorted({(a, b) for a, s, *_ in docs for b, t, _ in items if a is not None and b is not None and gram(s) & gram(t)})
    assert expected and sorted((r["doc_id"], r["item_id"]) for r in leaked_items(d, i, "doc_id", "item_id").collect()) == expected
    assert leaked_items(d.limit(0), i, "doc_id", "item_id").count() == 0
    assert leaked_items(d, i.limit(0), "doc_id", "item_id").count() == 0


def test_leaks_tolerate_substitutions(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    changed = text.replace("four", "quatre")
    d = spark.createDataFrame([(1, changed)], "doc_id int, text string")
    i = spark.createDataFrame([(2, text)], "item_id int, text string")
    hit = leaked_passages(d, i, "doc_id", "item_id").collect()
    assert hit and hit[0]["window_equal"] == 11 and leaked_items(d, i, "doc_id", "item_id").count() == 0
    assert leaked_items(d, i, "doc_id", "item_id", least_window_equal=11).count() == 1
    assert all(len(m) == leaks.WINDOW and "0" in m for m in leaks.MASKS)


def test_recall_of_leaks_with_substitutions():
    """Overlaps of 24 words with 1, 2 and 3 substituted ones: how many some mask finds."""
    rng = np.random.default_rng(3)
    recall = {}
    for n in (1, 2, 3):
        found = 0
        for _ in range(400):
            a = rng.integers(1, 1 << 60, 24).astype(np.uint64)
            b = a.copy()
            b[rng.choice(24, n, replace=False)] += np.uint64(1)
            of = lambda w: {(m, x) for m, _, h in leaks._seeds(w, np.array([0, 24])) for x in h.tolist()}
            found += bool(of(a) & of(b))
        recall[n] = found / 400
    print(recall)
    assert recall[1] == 1.0 and recall[2] > 0.9 and recall[3] > 0.6


PROSE = "The reader keeps the guide tree in memory, and the group checked every branch by hand. Nobody moved the files after the update, so the old names still hold."
TAGS = "cheap primers, gel stain, cheap primers, lab gloves, gel stain, cheap primers, lab gloves, gel stain, cheap primers"
LINKS = "\n".join(f"https://site{i}.example/page" for i in range(20))


def made_pages(rng, n):
    out = []
    for i in range(n):
        spam_page = i % 3 == 0
        parts = [rng.choice([TAGS, LINKS]) for _ in range(4)] if spam_page else [" ".join(rng.sample(PROSE.split(), 20)) + "." for _ in range(5)]
        out.append(("\n".join(parts), spam_page))
    return out


def test_model_on_held_out_pages():
    rng = random.Random(6)
    model = fit_pages(made_pages(rng, 60))
    held = made_pages(rng, 30)
    rows, _, page = spam._features([spam.lines_of(t) for t, _ in held], spam._Words(model.odds))
    path = model.states(rows, np.bincount(page))
    assert [(path[page == k] >= 2).mean() > 0.5 for k in range(30)] == [s for _, s in held]


def test_states_are_the_most_probable_ones():
    """Against all sequences of states, on pages of different lengths, an empty one among them."""
    rng = np.random.default_rng(1)
    model = fit_pages(made_pages(random.Random(6), 30))
    lengths = np.array([3, 0, 5, 1])
    rows = np.stack([rng.integers(0, b, lengths.sum()) for b in spam._BINS], 1).astype(np.int8)
    path, e = model.states(rows, lengths), model.log_emission(rows)
    for k, n in enumerate(lengths):
        at = int(lengths[:k].sum())
        score = lambda s: model.start[s[0]] + sum(model.move[x, y] for x, y in zip(s, s[1:])) + sum(e[at + t, x] for t, x in enumerate(s))  # noqa: B023, B905, E731
        if n:
            best = max(itertools.product(range(len(spam.STATES)), repeat=int(n)), key=score)
            assert score(tuple(path[at : at + n])) == pytest.approx(score(best))


def test_a_very_long_page_among_short_ones(spark):
    """Labelling takes memory in proportion to the lines, not to the longest page times the pages beside it."""
    model = fit_pages(made_pages(random.Random(6), 30))
    pages = [[["z"]]] * 255 + [[["https://a.example/x", "https://a.example/y"]] * 50_000]
    rows, sizes, page = spam._features(pages, spam._Words(model.odds))
    tracemalloc.start()
    path = model.states(rows, np.bincount(page))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(path) == 50_255 and (path[255:] >= 2).all() and peak < 4 << 20


def test_pages(spark):
    rng = random.Random(7)
    pages = made_pages(rng, 60)
    docs = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(pages)] + [(100, None, 1), (101, "", 1), (102, " \n", 1), (103, PROSE + "\n" + LINKS.split("\n")[0], 1), (104, "\n".join([LINKS] * 200), 1), (104, "\n".join([LINKS] * 200), 1)], "doc_id long, text string, words int")
    labels = spark.createDataFrame([(i, "spam" if s else "page") for i, (_, s) in enumerate(pages[:40])] + [(1, None), (None, "spam"), (3, "page"), (3, "spam")], "doc_id long, label string")
    found = [r["doc_id"] for r in list_pages(docs, labels).collect()]
    assert sorted(found) == sorted([i for i, (_, s) in enumerate(pages) if s] + [104, 104])
    assert list_pages(docs.limit(0), labels).count() == 0
    rules_only = [r["doc_id"] for r in list_pages(docs, labels.limit(0)).collect()]
    assert 104 in rules_only and 103 not in rules_only
    zero = {r["doc_id"]: r["words"] for r in page_shares(docs, fit_pages(pages), "doc_id", "text").collect()}
    assert zero[100] == zero[101] == zero[102] == 0
