"""Pages that carry template residue, filler, error messages or script notices instead of content.

1. *Slots.* Every visible text and title is searched directly for unresolved variables and the literals that
   a failed substitution leaves; their forms are given by the template languages.
2. *Lines.* Every sentence of every page is masked (numbers and codes become ``<*>``) and gets the odds of
   being an error message, a script notice, a helper line beside one, filler, or an order to the author, by
   ``message_model``. A line whose odds all stay below ``-REACH`` is ordinary whatever step 4 adds.
3. *Templates.* The other lines are mined as log lines are, by a fixed-depth prefix tree: line length, then
   ``DEPTH`` leading tokens, then the closest template of the leaf; tokens that differ become ``<*>``. A
   template pools what its lines show on all pages of all hosts: their odds, how much of their pages they
   make up, how many hosts share them, how often the status tells of an error.
4. *Verdicts.* Each template is classified once from its pooled odds and evidence, and its verdict goes to all
   lines it covers, so a line no one could judge by itself is known by the company it keeps.

One line of filler or one order anywhere in the visible text excludes a page. A block is a message where a
third of its sentences are; a page is found where its text blocks are messages, ``OUTWEIGH`` to each ordinary
one at least. No length of page, block or line changes that.

Code samples, comments, scripts and templates are no visible text (a page of nothing but code may be a
message: a stack trace); a noscript notice counts only where the body holds nothing else. Null or empty html
and null titles are never found, repeated rows count once, a status is one hint among others, and other
columns of the inputs are ignored.

Leaves may be hot, so lines are mined in ``PARTS`` parts of each leaf first; only the templates of the parts
meet in one task.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import urls
from sitegauge.llm.message_model import MessageModel, train
from sitegauge.llm.message_seeds import CLASSES
from sitegauge.operators.html import BLOCK, BOILERPLATE, HIDDEN, REST, plain, region
from sitegauge.plans.staging import join_by_group, spread, staged

#: Bound of the sample that shows the model ordinary lines: so many pages, those of the smallest hashed ids.
TRAIN_PAGES = 250
#: A block with this part of message sentences is a message; so many message blocks outweigh an ordinary one.
BLOCK_PART, OUTWEIGH = 3, 2
#: Leading tokens that choose the leaf, the share of equal tokens that joins a line to a template, parts of a leaf.
DEPTH, CLOSE, PARTS = 2, 0.7, 16
#: Most that pooled evidence can add to the odds of a template: status, share of the page, hosts.
STATUS_MOST, COVER_MOST, HOSTS_MOST = 1.5, 1.0, 0.25
#: Odds that messages, and filler and orders, must reach; pages of the base rate that error statuses are mixed with.
MESSAGE_ODDS, FILLER_ODDS, SHRINK = 0.75, 2.0, 20
REACH = STATUS_MOST + COVER_MOST + HOSTS_MOST - MESSAGE_ODDS
MESSAGES = CLASSES[1:]

#: Forms of unfilled variables, as template languages write them, and literals of failed ones.
_SLOT = re.compile(
    r"\{\{\{?[^{}]+\}\}|\{%[^%]+%\}|\[%[^%]+%\]|[$#]\{[^{}]+\}|\[\[[^\[\]]+\]\]|%%[A-Za-z_][\w.]*%%|<%.+?%>|\*\|[A-Za-z_][\w:.]*\|\*"
    r"|(?<![\w%])%[A-Z][A-Z0-9_]+%(?![\w%])|(?<![\w#])#[a-z]+(?:_[a-z]+)+#(?![\w#])|\{[a-z]+(?:_[a-z]+)+\}"
    r"|\b__[A-Z][A-Z0-9_]*__(?!\w)|@(?:Model|ViewBag|ViewData)\.\w+|\[object Object\]|\b(?:TODO|FIXME): ?\w"
    r"|\[(?:(?i:insert|your|enter|add|type))\b[^\[\]]+(?i:here)\]|<(?!/)[\w .]+ (?i:goes|comes) (?i:here)>"
)
_FAILED = re.compile(r"(?:^|[|·–:—-])\s*(?:undefined|null|NaN|None|\(null\)|\[object Object\])\s*(?:$|[|·–:—-])")
_MARK = re.compile(r"[{\[%<@*#]|__|TODO|FIXME")
_SENTENCE = re.compile(r"(?<=[.!?…])(?<!\b[Nn]o\.)\s+(?!\S*\d)")

_UNSEEN = region(HIDDEN + ("noscript", "code", "pre"))
_BODY = region(HIDDEN + BOILERPLATE)
_EDGE = re.compile(rf"<(/?(?:{'|'.join(BLOCK)}|title|br))(?=[\s/>]){REST}", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_NOSCRIPT = re.compile(rf"<noscript(?=[\s>]){REST}(.*?)</noscript", re.S | re.I)
_HEAD = re.compile(rf"<head(?=[\s>]){REST}.*?(?=</head|<body[\s>])", re.S | re.I)

ODDS = ", ".join(f"{c} double" for c in MESSAGES)
LINES = f"page_id long, role string, block int, sentences int, fill boolean, plain int, line string, times int, cover double, {ODDS}"
POOLED = ["uses", "seen", "cover", "errors", "hosts", *MESSAGES]
MINED = f"kind string, key string, text string, uses long, seen long, cover double, errors long, hosts long, {ODDS}"


def has_slot(text: str, alone: bool = False) -> bool:
    """Whether a text holds an unresolved variable, or (a title or block ``alone``) a failed literal."""
    return bool((_MARK.search(text) and _SLOT.search(text)) or (alone and _FAILED.search(text)))


_masked: dict[str, str] = {}


def _mask(token: str) -> str:
    bare = token.strip(".,;:!?…|-–()\"'")
    if len(_masked) > 500_000:
        _masked.clear()
    _masked[token] = out = "<status>" if re.fullmatch(r"[45]\d\d", bare) else "<*>" if re.search(r"\d", bare) else bare
    return out


def mask(line: str) -> tuple[str, ...]:
    """Lower-case tokens of a line; numbers and codes with digits become slots, status codes stay told apart."""
    known = _masked.get
    return tuple(m for t in line.lower().replace("’", " ").replace("'", " ").split() if (m := k if (k := known(t)) is not None else _mask(t)))


def sentences(block: str) -> list[tuple[str, ...]]:
    return [t for x in _SENTENCE.split(block) if (t := mask(x))]


def _blocks(html: str) -> tuple[list[tuple[str, str]], list[str]]:
    """(role, text) of the blocks of the body, and the texts of all visible blocks."""
    parts = _EDGE.split(_BODY.sub(" ", _HEAD.sub(" ", html)))
    body = [("heading" if role[:1] in "hH" and role[1:].isdigit() else "text", text) for role, part in zip(["", *parts[1::2]], parts[::2], strict=True) if (text := plain(part))]
    if not body:
        body = [("text", text) for x in _NOSCRIPT.findall(html) if (text := plain(_EDGE.sub(" ", x)))]
    return body, [x for x in map(plain, _EDGE.split(_UNSEEN.sub(" ", _HEAD.sub(" ", html)))[::2]) if x]


Line = tuple[str, ...]


def page_parts(html: str | None, title: str | None) -> tuple[list[tuple[str, bool, int, list[Line]]], list[Line], list[Line]] | None:
    """Blocks (role, visible, words, sentences) of the body, and the sentences of titles and of what lies beside it; None where a slot stands."""
    titles = [" ".join(title.split())] if title else []
    if html:
        titles += [plain(t) for t in _TITLE.findall(_UNSEEN.sub(" ", html) if "<noscript" in html else html)]
    body, visible = _blocks(html) if html else ([], [])
    if any(has_slot(t, True) for t in titles + visible):
        return None
    left = Counter(visible)
    blocks = []
    for role, text in body:
        fill = left[text] > 0
        left[text] -= fill
        blocks.append((role, fill, text.count(" ") + 1, sentences(text)))
    return blocks, [t for x in titles for t in sentences(x)], [t for x in left.elements() for t in sentences(x)]


def page_lines(parts: tuple[list[tuple[str, bool, int, list[Line]]], list[Line], list[Line]], odds: dict[Line, list[float]]) -> list[tuple]:
    """Lines of a page within reach, as ``LINES`` without the id; ``odds`` has those lines.

    ``plain`` is the number of text blocks of the body without any such line, ``sentences`` the number of
    sentences of the line's block and ``times`` how many of them it is, ``cover`` the block's share of the
    body's words; ``fill`` tells whether the line is visible text, where filler and orders count.
    """
    blocks, titles, beside = parts
    out: list[tuple] = []
    total = max(1, sum(words for _, _, words, _ in blocks))
    spare = 0
    for k, (role, fill, words, told) in enumerate(blocks):
        found = [(t, n) for t, n in Counter(told).items() if t in odds]
        if not found:
            spare += role == "text" and bool(told)
        out += [(role, k, len(told), fill, " ".join(t), n, words / total, *odds[t]) for t, n in found]
    for role, told in (("title", titles), ("beside", beside)):
        out += [(role, -1, 1, True, " ".join(t), 1, 0.0, *odds[t]) for t in dict.fromkeys(told) if t in odds]
    return [(*r[:4], spare, *r[4:]) for r in out]


class PrefixTree:
    """Templates of the lines of one leaf: same length, same leading tokens, enough equal tokens."""

    def __init__(self) -> None:
        self.templates: list[list[str]] = []
        self.exact: dict[tuple[str, ...], int] = {}
        # (position, token) -> templates that have it there
        self.having: dict[tuple[int, str], set[int]] = defaultdict(set)

    def add(self, tokens: list[str]) -> int:
        """Number of the template that covers the line, made more general or new where need be."""
        if (at := self.exact.get(tuple(tokens))) is not None:
            return at
        votes = Counter(k for at in enumerate(tokens) for k in self.having.get(at, ()))
        best = max(votes, key=lambda k: (votes[k], -k), default=None)
        if best is None or votes[best] < CLOSE * len(tokens):
            best = len(self.templates)
            self.templates.append(list(tokens))
            for at in enumerate(tokens):
                self.having[at].add(best)
        else:
            mine = self.templates[best]
            for i, (a, b) in enumerate(zip(mine, tokens, strict=True)):
                if a != b and a != "<*>":
                    self.having[i, a].discard(best)
                    self.having[i, "<*>"].add(best)
                    mine[i] = "<*>"
        self.exact[tuple(tokens)] = best
        return best


def _scan(model: MessageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.float64(), *[pa.float64()] * len(MESSAGES), pa.int64(), pa.bool_()]
        names = ["page_id", "role", "block", "sentences", "fill", "plain", "line", "times", "cover", *MESSAGES, "host", "failed"]
        for b in batches:
            rows: list[tuple] = []
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                ids, hosts, failed = (part.column(c).to_pylist() for c in ("page_id", "host", "failed"))
                told = [page_parts(h, t) for h, t in zip(part.column("html").to_pylist(), part.column("title").to_pylist(), strict=True)]
                lines = list({t: None for p in told if p for t in (*(x for blk in p[0] for x in blk[3]), *p[1], *p[2])})
                scores = model.odds(lines)[:, 1:]
                odds = {lines[k]: scores[k].tolist() for k in np.flatnonzero(scores.max(1, initial=-np.inf) > -REACH)}
                for i, p, host, bad in zip(ids, told, hosts, failed, strict=True):
                    found = [("slot", -1, 1, True, 0, "", 1, 0.0, *[0.0] * len(MESSAGES))] if p is None else page_lines(p, odds)
                    rows += [(i, *r, host, bad) for r in found]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def fit(pages: DataFrame) -> MessageModel:
    """Train the model with the lines of the bounded sample of pages."""
    told = pages.filter("page_id is not null and html <> ''")
    picked = told.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(TRAIN_PAGES)
    rows = told.join(F.broadcast(picked), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).collect()
    texts = ([text for _, text in body] + visible for body, visible in (_blocks(r.html) for r in rows))
    return train(t for blocks in texts for text in blocks for t in sentences(text))


def scanned(pages: DataFrame, reports: DataFrame) -> DataFrame:
    """``LINES`` with host and failed (an error status): slots found directly, and all lines within reach."""
    model = pages.sparkSession.sparkContext.broadcast(fit(pages))
    failed = F.coalesce(F.col("status_code") >= 400, F.lit(False)) if "status_code" in pages.columns else F.lit(False)
    # a bit for each of 64 groups of hosts: their number is estimated from the bits that stay unset
    host = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(urls.host(F.col("url"))), F.lit(64)).cast("int"))
    html = pages.filter("page_id is not null and html is not null").select("page_id", "html", F.lit(None).cast("string").alias("title"), host.alias("host"), failed.alias("failed"))
    titles = reports.filter("page_id is not null and meta.title is not null")
    titles = titles.select("page_id", F.lit(None).cast("string").alias("html"), F.col("meta.title").alias("title"), F.lit(0).cast("bigint").alias("host"), F.lit(False).alias("failed"))
    seen = spread(html.unionByName(titles)).mapInArrow(lambda b: _scan(model.value)(b), LINES + ", host long, failed boolean")
    return staged(seen.distinct())


def _pooled() -> list[Column]:
    """Aggregates that add up what templates or lines show; odds count once for each use."""
    total = F.sum("uses")
    odds = [(F.sum(F.col(c) * F.col("uses")) / total).alias(c) for c in MESSAGES]
    return [*odds, F.sum("seen").alias("seen"), F.sum("cover").alias("cover"), F.sum("errors").alias("errors"), F.bit_or("hosts").alias("hosts"), total.alias("uses")]


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by leaf -> ('line', template key, line, its figures) rows, then ('template', key, text) at each leaf's end."""
    tree, leaf = PrefixTree(), None

    def ends() -> list[tuple]:
        return [("template", f"{leaf}\t{k}", " ".join(t), *[None] * len(POOLED)) for k, t in enumerate(tree.templates)]

    for b in batches:
        out: list[tuple] = []
        for key, line, *figures in zip(*(b.column(c).to_pylist() for c in ("leaf", "line", *POOLED)), strict=True):
            if key != leaf:
                out += ends()
                tree, leaf = PrefixTree(), key
            out.append(("line", f"{key}\t{tree.add(line.split(' '))}", line, *figures))
        yield _rows(out)
    yield _rows(ends())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 3 + [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()] + [pa.float64()] * len(MESSAGES)
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["kind", "key", "text", *POOLED])


def _templates(lines: DataFrame, leaf: Column) -> tuple[DataFrame, DataFrame]:
    """Members (line, key) and templates (key, line, figures) of lines mined within ``leaf``."""
    ordered = lines.withColumn("leaf", leaf).repartition("leaf").sortWithinPartitions("leaf", F.desc("uses"), "line")
    out = staged(ordered.select("leaf", "line", *POOLED).mapInArrow(_mine, MINED))
    members = out.filter("kind = 'line'").withColumnRenamed("text", "line")
    found = members.groupBy("key").agg(*_pooled()).join(out.filter("kind = 'template'").select("key", F.col("text").alias("line")), "key")
    return members.select("line", "key", "uses"), staged(found)


def verdict(base: float) -> Column:
    """The class of a template from its pooled odds and evidence; ``base`` is the share of error statuses of all pages."""
    rate = (F.col("errors") + SHRINK * base) / (F.col("seen") + SHRINK)
    status = F.least(F.greatest(F.log(rate / base), F.lit(0.0)), F.lit(STATUS_MOST))
    cover = F.least(2 * F.col("cover") / F.greatest("seen", F.lit(1)) - 0.2, F.lit(COVER_MOST))
    unset = F.greatest(F.lit(64) - F.bit_count("hosts"), F.lit(1))
    hosts = F.least(F.log(F.greatest(F.lit(64.0) * F.log(F.lit(64.0) / unset), F.lit(1.0))) / 4, F.lit(HOSTS_MOST))
    message, filler = status + cover + hosts - MESSAGE_ODDS, hosts - FILLER_ODDS
    scored = [F.struct((F.col(c) + (filler if c in ("filler", "order") else message)).alias("odds"), F.lit(c).alias("verdict")) for c in MESSAGES]
    best = F.array_max(F.array(*scored))
    return F.when(best["odds"] > 0, best["verdict"]).otherwise("ordinary")


def mined(rows: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates (line, verdict, figures) of the scanned lines, and verdicts (line, uses, verdict) of the lines."""
    body = F.col("role").isin("heading", "text")
    figures = [
        F.count("*").alias("uses"), F.count_if(body).alias("seen"), F.sum(F.when(body, F.col("cover")).otherwise(0.0)).alias("cover"),
        F.count_if(body & F.col("failed")).alias("errors"), F.bit_or("host").alias("hosts"), *(F.any_value(c).alias(c) for c in MESSAGES),
    ]
    counted = rows.filter("role <> 'slot'").groupBy("line").agg(*figures)
    failed = F.count_if(F.col("status_code") >= 400) if "status_code" in pages.columns else F.lit(0)
    base = pages.agg((failed + 1) / (F.count("*") + 20)).first()[0]
    tokens = F.split("line", " ")
    leaf = F.concat_ws(" ", F.size(tokens).cast("string"), F.slice(tokens, 1, DEPTH))
    lines, parts = _templates(counted, F.concat_ws("\t", leaf, F.pmod(F.xxhash64("line"), F.lit(PARTS)).cast("string")))
    # the templates of a leaf's parts meet; a line finds its verdict by the template of its part
    again, whole = _templates(parts.drop("key"), leaf)
    judged = staged(whole.withColumn("verdict", verdict(base)))
    by_text = again.join(judged.select("key", "verdict"), "key").select("line", "verdict").distinct()
    sizes = lines.groupBy("key").agg(F.count("*").alias("lines"))
    by_part = staged(parts.select("key", "line").join(by_text, "line").join(sizes, "key").select("key", "verdict", "lines"))
    total = int(by_part.agg(F.sum("lines")).first()[0] or 0)
    return judged, staged(join_by_group(lines, by_part, ["key"], "lines", total).select("line", "uses", "verdict"))


def message_templates(pages: DataFrame, reports: DataFrame) -> DataFrame:
    """(template, verdict, uses): the mined templates, their verdicts and how many lines of pages each covers."""
    templates, _ = mined(scanned(pages, reports), pages)
    return templates.groupBy(F.col("line").alias("template"), "verdict").agg(F.sum("uses").alias("uses"))


def pages_to_exclude(pages: DataFrame, reports: DataFrame) -> DataFrame:
    """(page_id) of the pages to exclude, each once; see the module for what counts."""
    rows = scanned(pages, reports)
    _, told = mined(rows, pages)
    lines = rows.filter("role <> 'slot'").select("page_id", "role", "block", "sentences", "fill", "plain", "line", "times")
    judged = join_by_group(lines, told, ["line"], "uses", int(told.agg(F.sum("uses")).first()[0] or 0))
    filled = judged.filter("fill and verdict in ('filler', 'order')").select("page_id")
    times = lambda *verdicts: F.sum(F.when(F.col("verdict").isin(*verdicts), F.col("times")).otherwise(0))
    body = judged.filter("role in ('heading', 'text')").groupBy("page_id", "role", "block", "sentences", "plain")
    by_block = body.agg(times("error", "notice").alias("told"), times("helper").alias("quiet"))
    message = (F.col("told") > 0) & (BLOCK_PART * F.col("told") >= F.col("sentences"))
    text = F.col("role") == "text"
    by_page = by_block.groupBy("page_id", "plain").agg(
        F.count_if(message).alias("messages"), F.count_if(message & text).alias("texts"),
        F.count_if(~message & (F.col("told") + F.col("quiet") < F.col("sentences")) & text).alias("ordinary"),
    )
    whole = by_page.filter(f"messages > 0 and texts >= {OUTWEIGH} * (ordinary + plain)").select("page_id")
    return rows.filter("role = 'slot'").select("page_id").unionByName(filled).unionByName(whole).distinct()
