"""Main text of web pages by deducing the template of their host from equivalence classes of tokens.

Tokens are of two kinds. An element token is an element in its context, the path of element names (with their classes)
from the root. A text token is the whole text of a block in the context of its element. The occurrence
vector of a token says how often it occurs on each page of a host. Tokens of a host that share their vector form an equivalence class.
The class of the root, once on every page, is the skeleton; a class of ``SHARE`` of the pages or more belongs to
a layout. A class's text token is template if the class is the skeleton, or if it nests in its class: the element that
holds the text is in the same class, so this element has the same text wherever it occurs. All other texts are slots. Text
of the template is left out of the main text, under whatever names its elements have, unless the host has fewer than
``CONTENTS`` pages of different contents, or the template would take half of a page's words or more: then pages
are copies of one another, and what they share is no template.

Vectors are never collected. Each is summed to four numbers, the pages, the occurrences, and the occurrences times two hashes of
the page, so the classes are found by groupings with map-side combine however many pages a host has. Only classes
of ``SHARE`` of a host's pages or more are gathered, which are no more tokens than 1 / ``SHARE`` pages have. The template of a
host is one row and is joined back to its pages; hosts of many pages are salted for it.

The slot of the article is the outermost ``article`` of the skeleton, else its ``main`` or role main; a page that has not
got it (another layout) is looked at by itself. Without either it is the whole page. Inside the slot, elements that serve
another purpose by ``EXCLUDED`` and ``EXCLUDED_NAMES`` are left out; an element that is excluded by its name only and
holds more than half of the page's words is not.

Blocks are cut at block elements and line breaks; character references are decoded, white space in a block
becomes one space, blocks are joined by one line feed; nothing else is left out.

Defined cases: null or empty html gives the empty text; a null or odd url belongs to the host of the empty name;
repeated pages count as pages; unclosed elements end where their parents end, or where HTML says that they must;
an unclosed comment or script reaches to the end; elements may be nested to any depth. Extra columns are passed through;
``main_text`` replaces a column of its name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xxhash import xxh64_intdigest

from trustlake.llm.common import adding, named_back, parts, renamed, stored, text_or_empty

# Elements by their role in HTML, and usual names of what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("br td th tr tbody thead tfoot body html title".split())
ENDED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
EXCLUDED = frozenset(
    "head nav aside footer form button select textarea input script style noscript iframe template svg canvas "
    "object embed audio video menu dialog noembed noframes title".split()
)
EXCLUDED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu "
    "nav navbar navigation breadcrumb breadcrumbs pagination pager cookie cookies consent notice notification alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments reply replies respond discussion footer masthead topbar toolbar widget widgets search".split()
)
#: Never excluded by a name; an article or an element named main only by a whole class or id, not by a part of it.
WHOLE_PAGE = frozenset("html body main".split())
#: Excluded as a whole name only: a part of a name that says this often belongs to the article.
WHOLE_NAMES = frozenset(["search"])
#: Least share of a host's pages of a layout's class, least number of different contents of a host with a template,
#: pages of a host that go to one task, and most hosts that are salted (the pages in a task grow beyond).
SHARE, CONTENTS, TASK_PAGES, SALTED = 0.1, 3, 20_000, 100_000

TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: The path of the page itself; what names a token, and the sums of its vector.
ROOT = 0
TOKEN, TOKEN_TYPES = ("host", "token", "kind", "above", "label"), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
VECTOR = ("pages", "total", "a", "b")
NAMES, DIGITS = re.compile(r"[^a-z]+"), re.compile(r"\d+")


def host(url: str | Column) -> Column:
    """The lower-case host of a URL, empty if there is none."""
    found = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


@lru_cache(100_000)
def _path(above: int, label: str) -> int:
    """The number of an element's path, from the number of the one above it."""
    return xxh64_intdigest(label.encode("utf-8", "surrogatepass"), above) >> 1


@dataclass
class Path:
    """An element token of a page: how often it occurs, the path above, name and classes, whether it is excluded."""

    above: int
    label: str
    barred: bool
    n: int = 0


#: A text: its path, whether an element excludes it, the paths above it that are excluded by name, and the text.
Run = tuple[int, bool, tuple[int, ...], str]


def runs(html: str) -> tuple[list[Run | None], dict[int, Path]]:
    """The texts in page order, None for a block end; and the paths of the page."""
    out: list[Run | None] = []
    paths = {ROOT: Path(ROOT, "", False, 1)}
    # name, path, excluded by an element, paths excluded by name
    stack: list[tuple[str, int, bool, tuple[int, ...]]] = [("", ROOT, False, ())]

    def text(part: str) -> None:
        if part:
            _, path, hard, named = stack[-1]
            out.append((path, hard, named, unescape(part) if "&" in part else part))

    at, end = 0, len(html)
    while at < end:
        found = TAG.search(html, at)
        if not found:
            text(html[at:])
            break
        text(html[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            out.append(None)
        if found[1] or found[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in CLOSES_P:
            _end(stack, frozenset(["p"]), BLOCKS - frozenset(["p"]))
        if name in ENDED_BY:
            _end(stack, *ENDED_BY[name])
        label, by_name = _label(name, found[3] or found[6] or "")
        _, above, hard, named = stack[-1]
        path = _path(above, label)
        hard = hard or name in EXCLUDED
        if by_name and not hard:
            named = (*named, path)
        if path not in paths:
            paths[path] = Path(above, label, hard or bool(named))
        paths[path].n += 1
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
            if name == "textarea" or name == "title":
                stack.append((name, path, True, named))
                text(html[at : close.start() if close else end])
                stack.pop()
            at = close.start() if close else end
            continue
        stack.append((name, path, hard, named))
    return out, paths


def _end(stack: list, names: frozenset, within: frozenset) -> None:
    """Ends the innermost open element of ``names``, unless one of ``within`` is open inside it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] in names:
            del stack[i:]
            return
        if stack[i][0] in within:
            return


def _label(name: str, attributes: str) -> tuple[str, bool]:
    """Name and classes of an element, numbers left out; whether a name says that it serves another purpose."""
    if not attributes or "=" not in attributes:
        return name, False
    values = defaultdict(str, {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)})
    whole = {w for v in values.values() for w in v.split()}
    words = {part for w in whole for part in NAMES.split(w)} - WHOLE_NAMES | whole
    if name in WHOLE_PAGE:
        words = set()
    elif name == "article" or "main" in (values["id"], values["role"]):
        words = whole
    classes = ".".join(sorted(values["class"].split()))
    role = "[main]" if values["role"] == "main" else ""
    return DIGITS.sub("9", name + (f".{classes}" if classes else "") + role), not words.isdisjoint(EXCLUDED_NAMES)


@dataclass
class Block:
    """The texts of a block that nothing excludes, with their paths; its text, and its number as a text token."""

    parts: list[tuple[int, str]]

    def __post_init__(self):
        self.text = " ".join("".join(t for _, t in self.parts).split())
        self.path = next((p for p, t in self.parts if not t.isspace()), ROOT)
        self.token = xxh64_intdigest(self.text.encode("utf-8", "surrogatepass"), self.path) >> 1
        self.words = self.text.count(" ") + bool(self.text)


class Page:
    """The blocks of a page with text, without what is excluded, and its paths."""

    def __init__(self, html: str):
        texts, self.paths = runs(html)
        words: Counter = Counter()
        total = 0
        for run in texts:
            if run and not run[1]:
                n = len(run[3].split())
                total += n
                for path in run[2]:
                    words[path] += n
        # an element that is excluded by its name only but holds most of the page
        pardoned = {path for path, n in words.items() if 2 * n > total}
        if pardoned:
            for number, path in self.paths.items():
                path.barred = path.barred and not self._only(number, pardoned, texts)
        self.blocks: list[Block] = []
        parts: list[tuple[int, str]] = []
        for run in [*texts, None]:
            if run is None:
                if parts:
                    block = Block(parts)
                    if block.text:
                        self.blocks.append(block)
                parts = []
            elif not run[1] and pardoned.issuperset(run[2]):
                parts.append((run[0], run[3]))

    def _only(self, path: int, pardoned: set[int], texts: list[Run | None]) -> bool:
        """Whether the texts of a path are excluded by pardoned elements only."""
        return path in pardoned or any(r and r[0] == path and not r[1] and r[2] and pardoned.issuperset(r[2]) for r in texts)

    def under(self, top: int) -> set[int]:
        """The paths at and under ``top``."""
        found = {top}
        for number, path in self.paths.items():  # a path comes after the one above it
            if path.above in found:
                found.add(number)
        return found


def article_of(paths: dict[int, Path]) -> int:
    """The path of the article's element, the root if there is none. ``paths``: the paths that occur once a page."""

    def depth(number: int) -> int:
        n = 0
        while number != ROOT and number in paths:
            number, n = paths[number].above, n + 1
        return n

    for wanted in ("article", "main"):
        named = [p for p, x in paths.items() if not x.barred and re.match(rf"{wanted}(?![a-z])|.*\[main\]", x.label)]
        if named:
            return min(named, key=lambda p: (depth(p), p))
    return ROOT


def tokens(pages: DataFrame, html: str = "html") -> DataFrame:
    """(host, token, kind, above, label, pages, total, a, b, barred) from (host, html): tokens with their vectors' sums.

    ``kind`` is 0 for elements, 1 for texts (``above`` is the element's path), 2 for contents (the token is a hash of
    all blocks of a page).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sums: dict[tuple, list[int]] = {}
            for of, text in zip(batch.column("host").to_pylist(), text_or_empty(batch.column(html))):
                page = Page(text)
                digest = xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
                a, b = digest >> 40, digest & 0xFFFFFF
                found = [((of, p, 0, x.above, x.label), x.n, x.barred) for p, x in page.paths.items()]
                texts = Counter((of, k.token, 1, k.path, "") for k in page.blocks)
                found += [(key, n, False) for key, n in texts.items()]
                content = xxh64_intdigest(b"".join(k.token.to_bytes(8) for k in page.blocks)) >> 1
                found.append(((of, content, 2, ROOT, ""), 1, False))
                for key, n, barred in found:
                    row = sums.setdefault(key, [0] * 5)
                    for i, x in enumerate((1, n, n * a, n * b, barred)):
                        row[i] += x
            columns = [pa.array([k[i] for k in sums], kind) for i, kind in enumerate(TOKEN_TYPES)]
            columns += [pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(columns, names=[*TOKEN, *VECTOR, "barred"])

    schema = "host string, token long, kind int, above long, label string, pages long, total long, a long, b long, barred long"
    sums = [F.sum(n).alias(n) for n in (*VECTOR, "barred")]
    return pages.mapInArrow(run, schema).groupBy(*TOKEN).agg(*sums)


def _task_pages(hosts: DataFrame, pages: str) -> int:
    """Pages of a host beyond which it is salted or broadcast; at most SALTED hosts have more."""
    return max(TASK_PAGES, (hosts.agg(F.sum(pages).alias("n")).first()["n"] or 0) // SALTED)


def templates(found: DataFrame) -> DataFrame:
    """(host, pages, skeleton, texts, classes) of each host; ``found`` was made by ``tokens`` and written, as it is read twice.

    ``skeleton`` has the elements that occur once on every page, ``texts`` the text tokens of the template, ``classes`` is the
    number of valid classes.
    """
    one = F.col("token") == ROOT
    contents = stored(
        found.filter(one | (F.col("kind") == 2)).groupBy("host").agg(
            F.max(F.when(one, F.col("pages"))).alias("n"), F.sum(F.when(one, 0).otherwise(1)).alias("contents")
        ),
        "hosts",
    )
    # hosts of many pages, SALTED at most, are broadcast, so that their tokens stay where they are
    large = F.col("n") > _task_pages(contents, "n")
    few = F.broadcast(contents.filter(large))
    both = found.join(few, "host").unionByName(
        found.join(few.select("host"), "host", "left_anti").join(contents.filter(~large), "host")
    )
    # no more tokens of a host than 1 / SHARE pages have
    common = both.filter((F.col("kind") < 2) & (F.col("pages") >= SHARE * F.col("n")))
    element, text = F.col("kind") == 0, F.col("kind") == 1
    classes = common.groupBy("host", "n", "contents", *VECTOR).agg(
        F.max((F.col("token") == ROOT) & element).alias("root"),
        F.collect_list(F.when(element, F.struct("token", "above", "label", (F.col("barred") > 0).alias("barred")))).alias("elements"),
        F.collect_list(F.when(text, F.struct("token", "above"))).alias("texts"),
    )
    nested = F.filter("texts", lambda t: F.col("root") | F.array_contains(F.transform("elements", lambda e: e["token"]), t["above"]))
    valid = classes.withColumn("constant", F.when(F.col("contents") >= CONTENTS, F.transform(nested, lambda t: t["token"])).otherwise(F.array().cast("array<long>")))
    return valid.groupBy("host", F.col("n").alias("pages")).agg(
        F.first(F.when(F.col("root"), F.col("elements")), ignorenulls=True).alias("skeleton"),
        F.flatten(F.collect_list("constant")).alias("texts"),
        F.count(F.when(F.col("root") | (F.col(VECTOR[0]) > 1), 1)).alias("classes"),
    )


def slot_text(html: str, skeleton: dict[int, Path] | None = None, template: Collection[int] = ()) -> str:
    """The text of the article's slot, from the skeleton and the text tokens of the host's template."""
    page = Page(html)
    article = article_of(skeleton or {})
    if article not in page.paths or article == ROOT:
        article = article_of({p: x for p, x in page.paths.items() if x.n == 1})
    inside = page.under(article)
    kept = []
    for block in page.blocks:
        text = block.text if article == ROOT else " ".join("".join(t for p, t in block.parts if p in inside).split())
        if text:
            kept.append((block, text))
    shared = sum(block.words for block, _ in kept if block.token in template)
    if 2 * shared >= sum(block.words for block, _ in kept):
        template = ()
    return "\n".join(text for block, text in kept if block.token not in template)


def main_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with ``out``, the main text of each."""
    rows, names = renamed(pages)
    url, html = names[url], names[html]
    found = tokens(rows.select(host(url).alias("host"), F.col(html).alias("html")))
    chosen = stored(templates(stored(found, "tokens")), "templates")
    limit = _task_pages(chosen, "pages")
    salted = chosen.filter(F.col("pages") > limit).select("host", F.ceil(F.col("pages") / limit).alias("salts"))
    spread = rows.withColumn("host", host(url)).join(F.broadcast(salted), "host", "left").withColumns(
        {"salts": F.coalesce("salts", F.lit(1)), "salt": F.pmod(F.xxhash64(url, html), F.coalesce("salts", F.lit(1)))}
    )
    each = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("pages") / limit) - 1)))
    joined = spread.join(each.select("host", "salt", "skeleton", "texts"), ["host", "salt"], "left")

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            known: dict[str, tuple[dict[int, Path], frozenset[int]]] = {}
            texts = []
            whole = zip(text_or_empty(batch.column(html)), batch.column("host").to_pylist(), batch.column("skeleton"), batch.column("texts"))
            for page, of, skeleton, template in whole:
                if of not in known:
                    elements = {e["token"]: Path(e["above"], e["label"], e["barred"], 1) for e in skeleton.as_py() or []}
                    known[of] = elements, frozenset(template.as_py() or [])
                texts.append(slot_text(page, *known[of]))
            yield batch, [pa.array(texts, pa.string())]

    return named_back(adding(joined, T.StructType([T.StructField(out, T.StringType(), False)]), columns), names, [out])
