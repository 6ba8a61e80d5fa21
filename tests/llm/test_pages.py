import random

import pytest

from sitegauge.functions.text import words_of
from sitegauge.llm import language_crf, near_duplicates, template_residue

FETCH = "page_id long, html string, url string, words string"
REPORT = "page_id long, meta struct<title: string, description: string>, id string"
LOCALE = "page_id long, locale string, lang string"

SLOTS = [
    "{{ name }}", "a ${x.y} b", "%%TITLE%%", "[[a]]", "<%= x %>", "__NAME__", "@Model.City", "[INSERT NAME HERE]", "[Your name here]", "<name goes here>", "TODO: add x", "[object Object]", "#{a}", "{% block a %}",
    "Hi *|FNAME|*", "Welcome [% user.name %]", "Dear %FIRSTNAME%", "Dear {first_name}", "to #first_name#", "{{ " + "x" * 500 + " }}",
]
NO_SLOTS = ["", "undefined behaviour", "10 % of [a] and {b}", "Add a page before the next crawl.", "100%DV and 5%", "#top #news", "*|* a"]
FILLED = ["Sample text. Sample text. Sample text.", "asdf foo bar asdf qwer foo", "Lorem ipsum dolor sit amet elit sed", "Describe your story in two sentences.", "Beispieltext hier", "Texto de ejemplo"]
MESSAGES = ["Diese Seite gibt es leider nicht", "Esta página ya no está disponible", "Deze pagina bestaat niet meer", "Connection reset by peer", "Error 410: Gone", "Cette page n'existe plus", "Please turn on JavaScript to continue"]
REAL = "<p>The harbour opens at noon. Boats leave every hour. Guests meet at the old gate.</p>"
ABOUT = "<p>Designers replace dummy copy early, before lorem ipsum reaches a reader. A visitor who meets the words page not found leaves.</p>"


@pytest.mark.parametrize("text", SLOTS)
def test_slots(text):
    assert template_residue.has_slot(text)


@pytest.mark.parametrize("text", NO_SLOTS)
def test_no_slots(text):
    assert not template_residue.has_slot(text, True)


def excluded(spark, html, titles=(), status=None):
    pages = spark.createDataFrame([(i, h, f"https://h{i}.test/", status, "x") for i, h in html.items()] * 2 + [(None, "{{ x }}", None, None, None)], "page_id long, html string, url string, status_code int, line string")
    reports = spark.createDataFrame(list(titles), "page_id long, meta struct<title: string, description: string>, key string")
    return sorted(r.page_id for r in template_residue.pages_to_exclude(pages, reports).collect()), pages, reports


def test_pages_to_exclude(spark):
    html = {
        1: "<h1>404 | Page not found</h1><p>Return to the home page.</p>", 2: f"<noscript>Please enable JavaScript.</noscript>{REAL}", 3: "<body><noscript>Please enable JavaScript.</noscript><div id=app></div>",
        4: f"<pre>{{{{ x }}}}</pre><!-- {{{{ y }}}} --><script>'${{z}}'</script>{REAL}", 5: f"{REAL}<li>&#123;{{name}}&#x7d;", 6: None, 7: "", 8: "<p>Short but real.</p>", 9: REAL, 10: f"<h1>How we handle page not found</h1>{REAL}",
        11: f"{REAL}{ABOUT}", 12: ABOUT, **{20 + k: f"{REAL}<p>{x}</p>{REAL}" for k, x in enumerate(FILLED)}, **{40 + k: f"<h1>Site</h1><p>{x}</p>" for k, x in enumerate(MESSAGES)},
        60: f"<h1>undefined | Shop</h1>{REAL}",
    }
    titles = [(9, ("null - Site", None), None), (8, None, None), (8, (None, None), None), (11, ("Your title goes here", None), None)]
    found, pages, reports = excluded(spark, html, titles)
    assert found == [1, 3, 5, 9, 11, *range(20, 20 + len(FILLED)), *range(40, 40 + len(MESSAGES)), 60]
    assert template_residue.pages_to_exclude(pages.limit(0), reports.limit(0)).count() == 0
    assert {r.verdict for r in template_residue.message_templates(pages, reports).collect()} >= {"error", "notice", "filler", "order"}


def test_templates_decide_what_a_line_alone_does_not(spark):
    """Lines that say little by themselves: an error where a template pools them over hosts and error statuses, else ordinary."""
    names = "brook cliff dale fjord glen heath inlet knoll ledge marsh notch oasis plain quarry ridge shoal tarn upland vale weir".split()
    line = lambda k, x: (k, "text", 0, 1, True, 0, f"queue desk {x} closed entry <*>", 1, 1.0, -4.0, -1.5, -5.0, -5.0, -5.0, 1 << k, True)
    rows = spark.createDataFrame([line(k, x) for k, x in enumerate(names)], template_residue.LINES + ", host long, failed boolean")
    pages = spark.createDataFrame([(k, 503 if k < 20 else 200) for k in range(600)], "page_id long, status_code int")
    told = lambda df: {r.line.split()[2]: r.verdict for r in template_residue.mined(df, pages)[1].collect()}
    assert told(rows) == dict.fromkeys(names, "error")
    assert told(rows.filter("page_id = 3")) == {"fjord": "ordinary"}
    templates = template_residue.mined(rows, pages)[0].collect()
    assert [(r.line, r.uses) for r in templates] == [("queue desk <*> closed entry <*>", 20)]


def test_prefix_tree():
    tree = template_residue.PrefixTree()
    lines = ["user ann was not found today", "user bob was not found today", "user ann was here last monday", "go", "go", "stop"]
    assert [tree.add(x.split()) for x in lines] == [0, 0, 1, 2, 2, 3]
    assert tree.templates[0] == "user <*> was not found today".split()


def test_long_messages_are_found(spark):
    iis = (
        "The resource you are looking for (or one of its dependencies) could have been removed, had its name changed, or is temporarily unavailable. "
        "Please review the following URL and make sure that it is spelled correctly."
    )
    trace = "java.lang.IllegalStateException: no session " + " ".join(f"at shop.core.Step{k}.run(Step{k}.java:{k})" for k in range(70))
    real = " ".join(f"Stop {k} of the walk is the old mill, which has been removed from most maps. The path there is steep and wet in spring. Bring good boots and water." for k in range(9))
    spoken = "The page you requested could not be found. " * 5 + "It has been removed, or its address has changed. " * 5
    html = {
        1: f"<body><h1>Oops</h1><p>{iis}</p>", 2: f"<body><pre>{trace}</pre>", 3: f"<body><h1>Page not found</h1><p>The walk is long. It is wet. Bring water and boots. {real}</p>",
        4: f"<body><p>{iis}</p>" + "<p>The mill opens at nine and sells bread.</p>" * 4, 5: "<body><h1>Bad gateway</h1><p>Reference no. 8f2a</p>", 6: f"<body><p>{spoken}</p>",
    }
    assert excluded(spark, html)[0] == [1, 2, 5, 6]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    texts = {}
    for family in range(12):
        base = rng.choices(vocab, k=90)
        for copy in range(9 if family == 0 else 4):
            words = [w if rng.random() > 0.03 * copy else rng.choice(vocab) for w in base]
            texts[family * 20 + copy] = " ".join(words)
    texts[500] = texts[501] = texts[0].upper().replace(" ", ",  ")
    rows = [(i, f"<nav><p>menu</p></nav><p>{t}", None, None) for i, t in texts.items()]
    pages = spark.createDataFrame(rows + rows[:5] + [(900, None, None, None), (901, "<p>short", None, None), (None, rows[0][1], None, None)], FETCH)
    reports = spark.createDataFrame([(i, (None, " ".join(t.split()[:14])), None) for i, t in texts.items()] + [(1, None, None)], REPORT)

    def brute(items):
        sets = {i: set(zip(w, w[1:], w[2:])) for i, w in items.items()}
        return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}

    want = brute({i: words_of(t) for i, t in texts.items()})
    out = near_duplicates.near_duplicate_pages(pages, reports).collect()
    got = {(r.page_id_a, r.page_id_b) for r in out if r.field == "html"}
    assert got <= want and len(got) >= 0.99 * len(want) and (500, 501) in got
    short = brute({i: words_of(" ".join(t.split()[:14])) for i, t in texts.items()})
    got = {(r.page_id_a, r.page_id_b) for r in out if r.field == "description"}
    assert got <= short and len(got) >= 0.99 * len(short)
    classes = {(r.field, r.page_id): r for r in near_duplicates.near_duplicate_classes(pages, reports).collect()}
    assert classes["html", 501].text_id == classes["html", 500].text_id == 0
    for field, pairs in (("html", want), ("description", short)):
        root = {i: i for f, i in classes if f == field}
        for a, b in sorted(pairs) * len(root):
            root[a] = root[b] = min(root[a], root[b])
        assert {i: classes[field, i].class_id for i in root} == root
    assert near_duplicates.near_duplicate_pages(pages.limit(0), reports.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 300_000])
def test_a_large_class_has_few_links(spark, monkeypatch, few):
    """A thousand texts that are all alike: links grow with the texts, not with their pairs, and all end in one class."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(w if k != j and k != (j * 7) % 80 else f"x{n}" for k, w in enumerate(base)) for n in range(1000) for j in [rng.randrange(80)]]
    reps = spark.createDataFrame([("html", n, t) for n, t in enumerate(texts)], "field string, rep long, words string")
    monkeypatch.setattr(near_duplicates, "FEW_BUCKETS", few)
    links = near_duplicates.star_links(reps)
    assert links.count() < 160 * len(texts)
    labels = near_duplicates.grouped(reps.select("field", "rep"), links.filter("similarity >= 0.5").select("field", "a", "b")).collect()
    assert {r.label for r in labels} == {0} and len(labels) == len(texts)


SENTENCES = {
    "en": "the old harbour shows every small boat to the new guests of the town", "de": "der alte hafen zeigt die kleinen boote und das neue haus für alle gäste", "fr": "le vieux port montre les petits bateaux et la nouvelle maison pour tous",
    "es": "el viejo puerto muestra los barcos pequeños y la nueva casa para todos", "it": "il vecchio porto mostra le piccole barche e la nuova casa per tutti gli ospiti", "nl": "de oude haven toont het kleine schip en een nieuw huis voor alle gasten",
}


def test_languages(spark):
    para = {k: f"<p>{v}. {v}. {v}. {v}.</p>" for k, v in SENTENCES.items()}
    rows, locales = [], []
    for n in range(60):
        k = language_crf.LANGS[n % 6]
        rows.append((n, para[k] * 2, None, None))
        locales.append((n, {0: f" {k.upper()}-XX ", 1: f"{k}_AA", 2: k}[n % 3], None))
    mixed = para["en"] * 3 + para["de"] + "<p></p>" + para["de"] + para["en"]
    rows += [(100, mixed, None, None), (101, para["fr"] * 2, None, None), (102, para["nl"] * 2, None, None), (103, None, None, None), (104, "<p>kurz</p>", None, None), (100, mixed, None, None)]
    locales += [(100, "en", None), (100, "en", None), (101, "de-DE", None), (102, "default", None), (None, "en", None), (7, None, None)]
    df, loc = spark.createDataFrame(rows, FETCH), spark.createDataFrame(locales, LOCALE)
    got = sorted(tuple(r) for r in language_crf.found(df, loc).collect())
    assert got == [(100, 1, "en"), (100, 2, "de"), (100, 3, "en"), (101, 0, "fr"), (102, 0, "nl")]
    rated = language_crf.label_pages(df, language_crf.fit(df, loc)).collect()
    assert all(0 < r.confidence <= 1.0001 for r in rated)
    assert language_crf.found(df.limit(0), loc.limit(0)).count() == 0


def test_words_that_the_sample_lacks(spark):
    """A hundred parts with words of their own, of which the model's sample of pages has but a few."""
    rng = random.Random(11)
    rows, locales, want = [], [], []
    for part in range(100):
        own = {k: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9))) for _ in range(10)] for k in language_crf.LANGS}
        para = lambda k, own=own: f"<p>{' '.join(rng.choices(own[k], k=30))}</p>"
        for n, k in enumerate(language_crf.LANGS):
            other = language_crf.LANGS[(n + 1 + part % 5) % 6]
            for copy in range(10):
                page = (part * 6 + n) * 10 + copy
                rows.append((page, para(k) + para(k) + (para(other) if copy == 9 else ""), None, None))
                locales += [(page, other if copy == 8 else k, None)] * (copy != 7)
            want += [(page - 2, 0, k), (page - 1, 0, k), (page, 1, k), (page, 2, other)]
    got = language_crf.found(spark.createDataFrame(rows, FETCH), spark.createDataFrame(locales, LOCALE)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
