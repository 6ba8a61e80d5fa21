import base64
import os
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegauge.functions.text import words_of
from sitegauge.llm import format_copies, leakage, subjects, tokenize

DOCS = "doc_id long, text string, source string, item_id long"
FEED = "feed_id long, url string, canonical string, payload string, key string, n string"
have_vocabulary = pytest.mark.skipif(not os.path.exists(tokenize.VOCABULARY), reason="no vocabulary")


def test_copies(spark):
    a = ("https://A.test/x_y", "https://a.test/x", '{"title":"The Cat","h1Count":1,"status":"pass"}')
    rows = [
        (3, *a), (1, '"https://a.TEST/x-y"', " https://a.test/x", '{"h1Count":"1", "status":"PASS", "robots":null, "title":"the, cat!","description":""}'), (2, *a[:2], '{"title":"The Cat","h1Count":2,"status":"pass"}'),
        (4, *a[:2], '{"title":"TheCat","h1Count":1,"status":"pass"}'), (5, None, None, None), (6, "", " ", "{}"), (7, None, None, "not json"), (8, None, None, "NOT  json"), (9, None, None, "other"), (3, *a), (None, *a),
    ]
    df = spark.createDataFrame([(*r, None, None) for r in rows], FEED)
    assert sorted(tuple(r) for r in format_copies.copies(df).collect()) == [(1, 3), (5, 6), (7, 8)]
    assert {tuple(r) for r in format_copies.records(df).collect()} == {(1, 2), (2, 1), (4, 1), (5, 2), (7, 2), (9, 1)}
    assert format_copies.copies(df.limit(0)).count() == 0
    many = spark.range(3000).selectExpr("id as feed_id", "if(id % 3 = 0, 'U', concat('u', id)) as url", "'c' as canonical", "'{}' as payload")
    assert format_copies.copies(many).count() == 999


def _greedy(ranks, piece):
    parts = [bytes([b]) for b in piece.encode()]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


SMALL = {bytes([b]): b for b in range(256)} | {x: 256 + i for i, x in enumerate([b"aa", b"ab", b"aab", b"ba", b"aaaa", b"bab", b"ababa"])}


@given(st.lists(st.text("abc", min_size=1, max_size=14), max_size=8))
@settings(max_examples=150, deadline=None)
def test_pair_index_equals_greedy(words):
    assert tokenize.PairIndex(SMALL).encode(words, lambda t: [t]) == [_greedy(SMALL, w) for w in words]


@have_vocabulary
def test_token_ids(spark):
    tiktoken = pytest.importorskip("tiktoken")
    texts = [None, "", " ", "Hello  world\n\n don't <|endoftext|> 12345", "für 👩‍💻 日本語​", "x" * 20_000, "ab " * 30_000]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)
    own = tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=tokenize.read_ranks(), special_tokens={})
    got = {r.doc_id: r.ids for r in tokenize.encode_texts(df).collect()}
    assert got == {i: own.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert tokenize.encode_texts(df.limit(0)).count() == 0


def test_own_vocabulary_file(spark, tmp_path):
    path = tmp_path / "v.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in SMALL.items()))
    df = spark.createDataFrame([(1, "aab", None, None)], DOCS)
    assert tokenize.encode_texts(df, str(path)).first().ids == [258]


@given(st.lists(st.sampled_from("abcd"), max_size=60), st.lists(st.lists(st.sampled_from("abcd"), max_size=9), max_size=4))
@settings(max_examples=200, deadline=None)
def test_search_equals_brute_force(doc, items):
    want = {i for i, w in enumerate(items) for k in range(len(w) - 3) if any(doc[j : j + 4] == w[k : k + 4] for j in range(len(doc) - 3))}
    assert leakage.Passages([(i, " ".join(w)) for i, w in enumerate(items)], 4).items_in(doc) == want


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"x {item.upper().replace(' ', ' - ')} y", None, None), (2, " ".join(item.split()[:9]), None, None), (3, None, None, None), (4, "", None, None), (1, f"x {item}", None, None), (5, "pad " * 50_000 + item, None, None)]
    items = spark.createDataFrame([(7, item, None, 7), (7, None, None, 8), (7, "too short", None, 9), (7, item + " twelve", None, 10), (7, item, None, None)], DOCS)
    got = sorted(tuple(r) for r in leakage.leaks(spark.createDataFrame(docs, DOCS), items).collect())
    assert got == [(1, 7), (1, 10), (5, 7), (5, 10)]
    assert leakage.leaks(spark.createDataFrame([], DOCS), items).count() == 0


def test_many_and_long_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "WORDS_AT_ONCE", 40)
    words = [f"w{i}" for i in range(130)]
    cut = [" ".join(words[i : i + 10]) for i in range(121)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(cut)], DOCS)
    items = spark.createDataFrame([(None, " ".join(words), None, 1), (None, " ".join(words[:12]), None, 2)], DOCS)
    got = sorted(tuple(r) for r in leakage.leaks(docs, items).collect())
    assert got == sorted([(i, 1) for i in range(121)] + [(i, 2) for i in range(3)])


def test_few_labels_are_widened():
    import random

    rng = random.Random(5)
    topic = [[f"{a}{x}{y}" for x in "bcdfg" for y in "aeiouy"] for a in ("law", "sport")]
    text = lambda k: " ".join(f"the {rng.choice(topic[k])} of {rng.choice(topic[k])} and {rng.choice(topic[k])} is here." for _ in range(4)) if k is not None else "the page of menu and form is here."
    labelled = [(text(i % 2), "s", {i % 2}) for i in range(16)] + [(text(None), "s", set())] * 8
    more = [text(rng.randrange(2)) for _ in range(200)]
    few, many = subjects.train(labelled, ["law", "sport"]), subjects.train(labelled, ["law", "sport"], more=more)
    words = lambda m: {t for t in m.terms if " " not in t}
    assert len(words(many)) > len(words(few)) and all(w.startswith(many.subjects[many.terms[w][0]]) for w in words(many))


def test_subjects(spark):
    import random

    rng = random.Random(3)
    topic = {"law": "court judge clause verdict tribunal".split(), "sport": "match striker goal league referee".split()}
    plain = "page menu banner header link caption form report".split()
    sentence = lambda words: f"The {rng.choice(words)} meets the {rng.choice(words)} near the {rng.choice(plain)}."
    docs, labels, truth = [], [], defaultdict(set)
    for i in range(400):
        mine = [[], ["law"], ["sport"], ["law", "sport"]][i % 4]
        parts = [sentence(plain) for _ in range(4)] + [sentence(topic[t]) for t in mine for _ in range(4)]
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), f"s{i % 5}", None))
        truth[i] = set(mine)
        if i < 240:
            labels += [(i, f" {t.upper()}") for t in mine]
    docs += [(900, None, None, None), (901, "", None, None)]
    labels += [(1, None), (2, "nonsense")]
    frame = spark.createDataFrame(docs, DOCS)
    lab, areas = spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([("law", "Law", "courts and contracts"), ("sport", "Sport", None)], "subject string, title string, scope_note string")
    got = defaultdict(set)
    for r in subjects.found(frame, lab, areas).collect():
        got[r.doc_id].add(r.subject)
    held = range(240, 400)
    assert sum(got[i] == truth[i] for i in held) >= 0.9 * len(held) and not got[900] and not got[901]
    assert subjects.found(frame, lab.limit(0), areas).count() == 0
    assert subjects.found(frame.limit(0), lab, areas).count() == 0


def test_words_definition():
    assert words_of("A_b  É-1²") == ["a", "b", "é", "1²"]
