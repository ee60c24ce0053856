"""Main text of web pages by template deduction over the pages of a host.

Every page becomes tokens: its element paths, and the texts at them.  Tokens of one host
with the same occurrence vector (how often each page has them) form an equivalence class.
A class is valid if enough pages share it, it holds elements and these nest in one class.
Valid classes make up the host's template: their texts are the template's own, inside an
article too, and everything else fills a slot.  Slots in menus, notices, forms and the like,
told by element and class names, hold no main text; of the others, those inside an article
or main element come first, and the rest is the text only of pages without them.

Inside an article a class name counts only as a whole ("related-work" is not "related"),
and a name that articles use for their own parts too counts only for blocks that are
mostly links.  Repeated notices without such names are the template's to find.

Occurrence vectors are compared by an exclusive-or over pages of a hash of (page, count),
an aggregate that is combined before the shuffle, so a host with a third of all pages is
never gathered.  The hash of a token includes its host and its path, and that of a path
the hash of the path above, so tokens move as numbers, whatever the depth of a page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.tables import kept, map_batches

# Pages of a host that must share a class.
MIN_SUPPORT = 3

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe xmp svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
# Elements that an opening tag of the same group ends.
ENDS_ITSELF = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot div article section main nav aside footer header form body blockquote".split())
# Elements, and words of class, id or role, that hold no main text.
APART = frozenset("nav footer aside form head title dialog menu button select object audio video canvas".split()) | RAW
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion sidebar comment comments cookie cookies "
    "consent gdpr notice notices alert menu nav navbar navigation breadcrumb breadcrumbs footer newsletter subscribe "
    "subscription popup modal overlay share sharing social related recommended recommendations widget toolbar disclaimer "
    "reply replies discussion disqus respond login signup search pagination pager banner complementary contentinfo "
    "masthead topbar".split()
)
# Words that may stand beside those in a whole class name.
NEUTRAL_WORDS = frozenset(
    "area bar block body box button buttons container content form group inner item items left link links list main outer "
    "panel right section site text thread title top user wrap wrapper".split()
)
# Of the words above, those that articles use for their own parts too.
DOUBTFUL_WORDS = frozenset("alert discussion disclaimer menu notice notices reply related recommended search social".split())
HEADERS = frozenset(["header"])
MAIN = frozenset(["article", "main"])

_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(?:>|\Z))",
    re.DOTALL,
)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element(NamedTuple):
    name: str
    path: int
    apart: bool
    main: bool
    doubtful: bool


class Block(NamedTuple):
    token: int
    text: str
    main: bool


def _key(*parts: object) -> int:
    value = xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def _labels(attrs: str) -> tuple[str, list[set[str]], bool]:
    """First class name, the words of each name in class, id and role, and whether it is hidden."""
    first, names = "", []
    hidden = "hidden" in attrs.lower() and bool(_HIDDEN.search(_QUOTED.sub("=", attrs)))
    for kind, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "")
        if kind.lower() == "style":
            hidden = hidden or "display:none" in value.replace(" ", "").lower()
            continue
        if kind.lower() == "class" and value:
            first = value.split()[0] if value.split() else ""
        names += [{w.lower() for w in _WORD.findall(name)} for name in value.split()]
    return first, names, hidden


def _standing(names: list[set[str]], inside: bool) -> tuple[bool, bool]:
    """Whether an element's names set it apart, and whether they may, if its links agree."""
    if not inside:
        return any(words & APART_WORDS for words in names), False
    whole = [words & APART_WORDS for words in names if words <= APART_WORDS | NEUTRAL_WORDS]
    sure = any(words - DOUBTFUL_WORDS for words in whole)
    return sure, not sure and any(whole)


def parse(page: str, host: str = "") -> tuple[list[Block], dict[int, tuple[int, int]]]:
    """Blocks that may hold main text, and how often each element path occurs, with the path above it."""
    stack, blocks, parts = [Element("", _key(host), False, False, False)], [], []
    opened: Counter[str] = Counter()
    paths: dict[int, tuple[int, int]] = {}
    linked, in_link = 0, False

    def close_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        top = stack[-1]
        if text and not top.apart and not (top.doubtful and 2 * linked >= len(text)):
            blocks.append(Block(_key(top.path, text), text, top.main))
        linked = 0

    def leave(name: str, inside: frozenset[str] = frozenset()) -> None:
        """Close the nearest open element of a name, and all in it, unless one of ``inside`` is nearer."""
        if not opened[name]:
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name == name:
                opened.subtract(e.name for e in stack[depth:])
                del stack[depth:]
                return
            if stack[depth].name in inside:
                return

    def count(path: int, above: int) -> None:
        paths[path] = (above, paths.get(path, (0, 0))[1] + 1)

    at = 0
    while True:
        found = _TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text and not stack[-1].apart:
            parts.append(entities.unescape(text))
            linked += len(parts[-1].strip()) if in_link else 0
        if not found:
            break
        at = found.end()
        if not found["name"]:
            continue
        name = found["name"].lower()
        if name == "a":
            in_link = not found["close"]
            continue
        if found["close"]:
            if name in BLOCK:
                close_block()
                leave(name)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW and not found["attrs"].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            count(_key(stack[-1].path, name), stack[-1].path)
        elif name in BLOCK:
            close_block()
            for same in ENDS_ITSELF.get(name, ()):
                leave(same, CONTAINERS)
            if name in CONTAINERS or name[0] == "h" and name[1:].isdigit():
                leave("p")
            label, names, hidden = _labels(found["attrs"])
            up = stack[-1]
            path = _key(up.path, f"{name}.{label}" if label else name)
            named, doubtful = _standing(names, up.main) if name not in ("html", "body", "main") else (False, False)
            heading = name in HEADERS or name not in ("html", "body") and any("header" in words for words in names)
            apart = up.apart or name in APART or named or hidden or heading and not up.main
            main = (up.main or name in MAIN) and not apart
            if name not in VOID:
                stack.append(Element(name, path, apart, main, up.doubtful or doubtful))
                opened[name] += 1
            count(path, up.path)
    close_block()
    return blocks, paths


BLOCK_TYPE = pa.struct([("token", pa.int64()), ("text", pa.string()), ("main", pa.bool_()), ("n", pa.int32())])
PATH_TYPE = pa.struct([("token", pa.int64()), ("above", pa.int64()), ("n", pa.int32())])


def _parse_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys, blocks, paths = [], [], []
    for page, host in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist()):
        found, counts = parse(page or "", host)
        keys.append(_key(host, page or ""))
        # A text's count stands at its first block; the page's other blocks with it have 0.
        times = Counter(b.token for b in found)
        blocks.append([{**b._asdict(), "n": times.pop(b.token, 0)} for b in found])
        paths.append([{"token": t, "above": above, "n": n} for t, (above, n) in counts.items()])
    columns = {name: batch.column(name) for name in ("page_id", "url")}
    columns |= {"key": pa.array(keys, pa.int64())}
    columns |= {"blocks": pa.array(blocks, pa.list_(BLOCK_TYPE)), "paths": pa.array(paths, pa.list_(PATH_TYPE))}
    return pa.RecordBatch.from_pydict(columns)


PARSED = (
    "page_id long, url string, key long, blocks array<struct<token: bigint, text: string, main: boolean, n: int>>, "
    "paths array<struct<token: bigint, above: bigint, n: int>>"
)


def parsed(pages: DataFrame) -> DataFrame:
    """Blocks and paths of every page, with a row number.  Pages without a url share the host ''."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit("")))
    columns = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), host.alias("host"), F.col("html").cast("string")
    )
    return map_batches(columns, _parse_batch, PARSED).withColumn("row", F.monotonically_increasing_id())


def templates(pages: DataFrame) -> DataFrame:
    """Tokens of valid classes: ``(token, class, support, above)``; ``above`` is null for texts.

    A page counts once however often its row is repeated.
    """
    first = pages.groupBy("key").agg(F.min("row").alias("row"), F.count("*").alias("rows")).where("rows > 1")
    again = pages.select("key", "row").join(first.select("key", F.col("row").alias("first")), "key").where("row != first")
    texts = F.transform("blocks", lambda b: F.struct(b["token"].alias("token"), F.lit(None).cast("long").alias("above"), b["n"].alias("n")))
    one = pages.select("key", "row", F.concat("paths", F.filter(texts, lambda t: t["n"] > 0)).alias("tokens"))
    # Written first, so that its size decides how it is joined; texts don't take part.
    one = one.join(kept(again.select("row")), "row", "left_anti").select("key", F.inline("tokens"))
    tokens = one.groupBy("token").agg(
        F.bit_xor(F.xxhash64("key", "n")).alias("class"), F.count("*").cast("int").alias("support"), F.max("above").alias("above")
    )
    tokens = kept(tokens.where(F.col("support") >= MIN_SUPPORT))
    # The class of each path's parent; the paths of a host are few beside its pages.
    upper = tokens.where("above is not null").select(F.col("token").alias("above"), F.col("class").alias("outer"))
    nested = tokens.join(upper, "above", "left").withColumn(
        "outer", F.when(F.col("outer") != F.col("class"), F.col("outer"))
    )
    classes = nested.groupBy("class").agg(
        F.count("*").alias("size"), F.count("above").alias("paths"),
        F.min("outer").alias("first"), F.max("outer").alias("last"),
    )
    valid = classes.where("size > 1 and paths > 0 and (first is null or first = last)")
    return tokens.join(valid.select("class"), "class", "left_semi")


def template_texts(pages: DataFrame) -> DataFrame:
    """``(row, gone)``: per page the tokens of its texts that are the template's own.

    Pages that are copies of each other have all their texts in common; a text is a
    template's own only if some page with it has other text besides.
    """
    own = templates(pages).where("above is null").select("token")
    texts = F.filter("blocks", lambda b: b["n"] > 0)
    tokens = pages.select("row", F.size(texts).alias("texts"), F.explode(F.transform(texts, lambda b: b["token"])).alias("token"))
    per_page = tokens.join(own, "token", "left_semi").groupBy("row").agg(
        F.collect_list("token").alias("gone"), F.max("texts").alias("texts")
    )
    per_page = kept(per_page.select("row", "gone", (F.col("texts") > F.size("gone")).alias("filled")))
    filled = per_page.where("filled").select("row", "gone")
    sure = filled.select(F.explode("gone").alias("token")).distinct()
    whole = per_page.where("not filled").select("row", F.explode("gone").alias("token"))
    whole = whole.join(sure, "token", "left_semi").groupBy("row")
    return filled.unionByName(whole.agg(F.collect_list("token").alias("gone")))


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per page.

    A null or empty page has an empty text; repeated rows and null ids give a row each;
    extra columns are ignored; an empty table gives no rows.  The text is that of the slots
    inside an article, or of all slots without one, less the template's own texts, which
    takes a host with at least ``MIN_SUPPORT`` different pages.
    """
    all_ = kept(parsed(pages), "zstd")
    rows = all_.select("page_id", "url", "row", "blocks").join(template_texts(all_), "row", "left")
    slots = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("gone", b["token"]), F.lit(False)))
    rows = rows.select("page_id", "url", slots.alias("slots")).withColumn("inside", F.filter("slots", lambda b: b["main"]))
    best = F.when(F.size("inside") > 0, F.col("inside")).otherwise(F.col("slots"))
    text = F.array_join(F.transform(best, lambda b: b["text"]), " ")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
