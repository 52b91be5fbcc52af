"""3. Main text of HTML pages by templates deduced from the pages of a host.

Tokens are containers, named by their path of tags (with the first class or id), and runs of text between blocks, named
by path and words. A token's occurrence vector counts it on each of its host's distinct pages; it is summed up as a
mergeable signature (sum over pages of a hash of page and count), so vectors are compared without bringing a host's
pages together. Tokens of equal vectors form a class. A class is a candidate if its tokens are on at least `MIN_PAGES` pages and half of the
host's, once on each. The pages are then read with their host's candidates: a class is valid if its tokens' ends stand in one order, and if it lies in one
place (between the same two ends of the same class, or of none), on at least AGREE of its pages. Containers of valid classes nest into the template,
whose slots are what is left inside each. The slot with the most text beside the template's own is the host's main slot; a page's
article is the region around it (see main_text). Text of valid classes goes; in the main slot only what is on at least AGREE of
the host's pages does, so a line that many articles share stays. Names of tags and classes only decide about slots that recur beside the main slot.

Pages count as one if their longest run of text is equal, so copies of an article are no template; a host of fewer than
`MIN_PAGES` distinct pages has none, and its pages are read each by itself. Null and empty html give ""; null urls form a host;
repeated rows count once. A page without containers is one slot. Nothing is capped. Columns of the same name as `out`
are replaced, other extra columns are kept.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices

MIN_PAGES, AGREE, SEP, BROADCAST = 3, 0.9, "\x1f", 64 << 20
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_UNQUOTED = re.compile(r"=[^\s\"']+/\Z")  # the slash belongs to an attribute's value
# HTML element kinds.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title"}
SKIP = {"nav", "footer", "aside", "form", "head", "button", "select", "menu", "dialog"} | RAW
REGION = {"html", "body", "div", "section", "article", "main", "center", "form"}
HOLD = {"ul", "ol", "dl", "table", "td", "header"} | REGION | SKIP
BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "blockquote", "pre", "figcaption", "figure", "hr", "caption", "address"} | HOLD
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed"}
# Names of slots beside the main one; a choice of ours, used where a template leaves the question open.
SIDE = "ads?|advert\\w*|banner|sponsor\\w*|promo\\w*|side-?bar|menu|nav\\w*|footer|cookies?|notice|consent|popup|modal|newsletter|subscribe|share|social|related|breadcrumbs?|comments?|disqus|repl(?:y|ies)|login|signup|widget"
JUNK = re.compile(rf"(?:^|[\s_-])(?:{SIDE})(?:$|[\s_-])", re.I)
HEAD = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
Path = tuple[str, ...]


class Block(NamedTuple):
    path: Path
    kinds: str  # for each container: s(kipped tag), j(unk name), h(eader) or -
    text: str
    linked: int  # characters inside links


def parse(page: str, ends: dict | None = None) -> tuple[list[Block], Counter]:
    """Blocks in page order, and how often each container path is opened.

    ends gets the places, counted over blocks and tags, where each container path opens and closes, and each text token stands.
    """
    out, opened, stack, buf, at, link, linked, place = [], Counter({(): 1}), [], [], 0, False, 0, 0

    def shut(i: int) -> None:
        nonlocal place
        while len(stack) > i:
            if ends is not None:
                place += 1
                ends.setdefault(SEP.join(x[1] for x in stack), []).append(place)
            stack.pop()

    def flush() -> None:
        nonlocal linked, place
        text = " ".join(unescape("".join(buf)).split())
        buf.clear()
        if text:
            out.append(Block(tuple(x[1] for x in stack), "".join(x[2] for x in stack), text, linked))
            if ends is not None:
                place += 1
                ends.setdefault(text_token(out[-1]), []).append(place)
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        piece = page[at:m.start()]
        buf.append(piece)
        linked += len(piece) if link else 0
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            flush()
            if m[3].endswith("/") and not _UNQUOTED.search(m[3]):  # an empty element
                continue
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "a":
            link = not m[1]
        if tag == "br":
            buf.append(" ")
            continue
        if tag not in BLOCK:
            continue
        flush()
        if tag not in HOLD or tag in VOID:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    shut(i)
                    break
        elif not m[3].endswith("/"):
            names = " ".join(next(filter(None, n), "") for n in _NAME.findall(m[3]))
            kind = "s" if tag in SKIP else "j" if tag not in ("html", "body", "main") and JUNK.search(names) else "h" if tag == "header" or HEAD.search(names) else "-"
            stack.append((tag, tag + ("." + names.split()[0] if names.split() else ""), kind))
            opened[tuple(x[1] for x in stack)] += 1
            if ends is not None:
                place += 1
                ends.setdefault(SEP.join(x[1] for x in stack), []).append(place)
    piece = page[at:]
    buf.append(piece)
    linked += len(piece) if link else 0
    flush()
    shut(0)
    return out, opened


def text_token(block: Block) -> int:
    """Signed 64-bit name of a run of text at its path."""
    h = xxhash.xxh64_intdigest(f"{SEP.join(block.path)}\x1e{block.text}".encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def classes(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, path, text, pages, most, mass, class_id, all_pages): each token of each host with its class.

    text is null for containers, else the run's name; pages: distinct pages that have it; most: its greatest count on one;
    mass: characters directly inside a container; class_id: signature of the occurrence vector; all_pages: the host's.
    Runs of text on fewer than MIN_PAGES pages are left out.
    """
    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, "html"):
                rows = []
                for host, page in zip(part["host"], part["html"]):
                    blocks, opened = parse(page)
                    longest = max((b.text for b in blocks), key=lambda t: (len(t), t), default="")
                    sign = xxhash.xxh64_intdigest(longest.encode("utf-8", "surrogatepass")) >> 1
                    mass: dict[Path, int] = defaultdict(int)
                    for b in blocks:
                        mass[b.path] += len(b.text)
                    rows += [(host, sign, SEP.join(p), None, n, mass[p]) for p, n in opened.items()]
                    runs = Counter((SEP.join(b.path), text_token(b), len(b.text)) for b in blocks)
                    rows += [(host, sign, p, t, n, n * size) for (p, t, size), n in runs.items()]
                host, sign, path, text, n, mass = map(list, zip(*rows))
                yield pd.DataFrame({"host": host, "sign": sign, "path": path, "text": pd.array(text, "Int64"), "n": n, "mass": mass})

    src = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    t = src.mapInPandas(tokens, "host string, sign long, path string, text long, n long, mass long")
    t = t.groupBy("host", "path", "text", "sign").agg(F.max("n").alias("n"), F.max("mass").alias("mass"))
    # whole sums of 64 bits would overflow: both halves of the hash are summed for themselves
    h = F.xxhash64("sign", "n")
    t = t.groupBy("host", "path", "text").agg(F.count("*").alias("pages"), F.max("n").alias("most"), F.sum("mass").alias("mass"),
                                              F.sum(F.shiftrightunsigned(h, 32)).alias("hi"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"))
    t = materialize(t.filter(F.col("text").isNull() | (F.col("pages") >= MIN_PAGES)).withColumn("class_id", F.xxhash64("hi", "lo")).drop("hi", "lo"))
    hosts = t.filter((F.col("path") == "") & F.col("text").isNull()).select("host", F.col("pages").alias("all_pages"))
    return t.join(hosts, "host")


def arrangement(page: str, known: dict) -> list[tuple[int, int, int]]:
    """(class, order, place) of the candidate classes on a page: hashes of the order of its tokens' ends, and of where it lies.

    known: the class of each container path and text token. A class lies in the narrowest gap between two neighbouring ends of another class that
    holds all its own ends; one that lies in none is at the root.
    """
    ends: dict = {}
    parse(page or "", ends)
    of: dict[int, list] = defaultdict(list)
    for token, at in ends.items():
        if token in known:
            of[known[token]] += [(p, str(token)) for p in at]
    spots = {c: sorted(x) for c, x in of.items()}
    places = {c: [p for p, _ in x] for c, x in spots.items()}
    out = []
    for c, x in spots.items():
        best = (1 << 60, None, 0)
        for other, at in places.items():
            k = bisect.bisect(at, x[0][0])
            if other != c and 0 < k < len(at) and at[k] > x[-1][0]:
                best = min(best, (at[k] - at[k - 1], other, k))
        digest = lambda t: xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1
        out.append((c, digest(SEP.join(t for _, t in x)), digest(f"{best[1]}{SEP}{best[2]}")))
    return out


def valid_classes(pages: DataFrame, tokens: DataFrame, html_col: str = "html", url_col: str = "url", limit: int = BROADCAST) -> DataFrame:
    """(host, class_id) of the candidates among tokens (classes) that keep one order and one place on at least AGREE of their pages."""
    fit = (F.col("pages") >= MIN_PAGES) & (F.col("pages") * 2 >= F.col("all_pages")) & (F.col("most") == 1) & ((F.col("path") != "") | F.col("text").isNotNull())
    some = tokens.filter(fit).groupBy("host", "all_pages").agg(F.collect_list(F.struct(F.when(F.col("text").isNull(), F.col("path")).alias("path"), "text", "class_id")).alias("t"))
    some = materialize(some.select("host", "all_pages", F.col("t.path").alias("paths"), F.col("t.text").alias("texts"), F.col("t.class_id").alias("ids")))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            seen: Counter = Counter()
            for host, page, paths, texts, ids in zip(pdf["host"], pdf["html"], pdf["paths"], pdf["texts"], pdf["ids"]):
                if host not in held:
                    if len(held) > 256:
                        held.clear()
                    # nulls may make floats of the numbers' array: they are whole only as Python objects
                    held[host] = {(p if p is not None else int(t)): int(c) for p, t, c in zip(paths, texts, ids)}
                seen.update((host, *x) for x in arrangement(page, held[host]))
            rows = [(*k, n) for k, n in seen.items()]
            yield pd.DataFrame(rows, columns=["host", "class_id", "order", "place", "n"])

    size = F.lit(64) + 24 * F.size("ids") + F.length(F.array_join("paths", ""))
    src = attached(pages.select(host_of(F.col(url_col)).alias("__host"), F.col(html_col).alias("html")), some, size, ["paths", "texts", "ids"], limit).filter("ids is not null")
    seen = src.select(F.col("__host").alias("host"), "html", "paths", F.transform("texts", lambda x: x.cast("string")).alias("texts"), F.transform("ids", lambda x: x.cast("string")).alias("ids"))
    seen = seen.mapInPandas(look, "host string, class_id long, order long, place long, n long").groupBy("host", "class_id", "order", "place").agg(F.sum("n").alias("n"))
    total = seen.groupBy("host", "class_id").agg(F.sum("n").alias("n"))
    for kind in ("order", "place"):
        most = seen.groupBy("host", "class_id", kind).agg(F.sum("n").alias("m")).groupBy("host", "class_id").agg(F.max("m").alias(kind))
        total = total.join(most, ["host", "class_id"])
    return total.filter((F.col("order") >= AGREE * F.col("n")) & (F.col("place") >= AGREE * F.col("n"))).select("host", "class_id")


def templates(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, all_pages, containers, texts, always, main): the template of each host, a written table.

    containers: paths of the containers of valid classes; texts: runs of text of valid classes, always: those on nearly all pages; main: the path
    of the slot with the most text left, slots in tags or recurring names of boilerplate last; null without a template.
    """
    t = classes(pages, html_col, url_col)
    valid = materialize(valid_classes(pages, t, html_col, url_col)).withColumn("valid", F.lit(True))
    t = t.join(valid, ["host", "class_id"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)) & (F.col("most") == 1))
    valid = F.col("valid")
    known = t.filter(valid).groupBy("host", "all_pages").agg(
        F.array_sort(F.collect_set(F.when(F.col("text").isNull() & (F.col("path") != ""), F.col("path")))).alias("containers"),
        F.array_sort(F.collect_set(F.when(F.col("text").isNotNull(), F.col("text")))).alias("texts"),
        F.array_sort(F.collect_set(F.when(F.col("text").isNotNull() & (F.col("pages") >= AGREE * F.col("all_pages")), F.col("text")))).alias("always"))
    left = t.filter(F.col("text").isNull()).select("host", "path", "mass")
    left = left.unionByName(t.filter(valid & F.col("text").isNotNull()).select("host", "path", (-F.col("mass")).alias("mass")))
    # a longer prefix of a path sorts behind a shorter one
    slot = F.array_max(F.filter("containers", lambda c: (c == F.col("path")) | F.startswith(F.col("path"), F.concat(c, F.lit(SEP)))))
    end = rf"(?:[_-]|{SEP}|$)"
    side = F.col("slot").rlike(rf"(?:^|{SEP})(?:(?:{'|'.join(sorted(SKIP - {'form'}))})(?:\.|{SEP}|$)|[^.{SEP}]*\.(?:[^{SEP}]*[_-])?(?i:{SIDE}){end})")
    slots = left.join(known, "host").groupBy("host", slot.alias("slot")).agg(F.sum("mass").alias("mass"))
    main = slots.filter("slot is not null").groupBy("host").agg(F.max_by("slot", F.struct((~side).alias("own"), "mass", "slot")).alias("main"))
    return materialize(known.join(main, "host", "left"))


def _region(path: Path) -> Path:
    while path and path[-1].split(".")[0] not in REGION:
        path = path[:-1]
    return path


def main_text(page: str | None, containers: frozenset = frozenset(), texts: frozenset = frozenset(), main: Path | None = None, always: frozenset = frozenset()) -> str:
    """The article of a page, given its host's template.

    Runs of template text go; inside the main slot (or the article element around it) only those on nearly all pages do. The region starts at the main slot (without one below the body, or where the page lacks it, at the
    page's own container with the most text). Inside article or main elements it takes all such elements outermost on the page; else
    it grows to the container around it while it holds half of the text there, up to the body, of which it takes only the blocks
    directly inside. Of the region's blocks those go that lie in boilerplate tags, in containers of mostly links,
    or in containers whose name says so and that recur in the template (or if there is none), unless
    the main slot is inside them.
    """
    blocks, _ = parse(page or "")
    if main is not None and (not _region(main) or _region(main)[-1].split(".")[0] in ("html", "body")):
        main = None  # the whole page is no slot: its pages are laid out differently
    named = [i for i, x in enumerate(main or ()) if x.split(".")[0] in ("article", "main")]
    core = main[:named[0] + 1] if named else main
    rest = [b for b in blocks if text_token(b) not in (always if core and b.path[:len(core)] == core else texts)] if texts else blocks
    if not rest:
        return ""
    if main is None or not any(b.path[:len(main)] == main for b in rest):
        mass: dict = defaultdict(int)
        for b in rest:
            mass["s" in b.kinds or "j" in b.kinds, _region(b.path)] += len(b.text)
        main = max(mass, key=lambda k: (not k[0], mass[k], k[1]))[1]
    main = _region(main)

    def own(b: Block) -> bool:
        for i, kind in enumerate(b.kinds):
            outer = b.path[:i + 1]
            if kind != "-" and kind != "h" and main[:i + 1] != outer and (kind == "s" or not containers or SEP.join(outer) in containers):
                return False
        return True

    rest = [b for b in rest if own(b)]
    named = [i for i, x in enumerate(main) if x.split(".")[0] in ("article", "main")]
    if named:
        tag = "article" if any(main[i].split(".")[0] == "article" for i in named) else "main"
        return "\n".join(b.text for b in rest if any(x.split(".")[0] == tag for x in b.path))

    region = main
    inside = [b for b in rest if b.path[:len(region)] == region]
    while region:
        outer = _region(region[:-1])
        if outer == region or not outer:
            break
        around, flat = [b for b in rest if b.path[:len(outer)] == outer], outer[-1].split(".")[0] in ("body", "html")
        children: dict = defaultdict(list)
        for b in around:
            children[b.path[:len(outer) + 1]].append(b)
        dense = {c for c, bs in children.items() if c != outer and 2 * sum(b.linked for b in bs) > sum(len(b.text) for b in bs)}

        def joins(b: Block) -> bool:
            child = b.path[:len(outer) + 1]
            if b.path[:len(region)] == region:
                return True
            return child not in dense and not any(k == "h" for k in b.kinds[len(outer):] if flat) and (not flat or _region(b.path) == outer)

        grown = [b for b in around if joins(b)]
        if 2 * sum(len(b.text) for b in inside) < sum(len(b.text) for b in grown):
            break
        kept = set(map(id, inside))
        inside = [b for b in grown if b.path[:len(region)] != region or id(b) in kept]
        region = outer
    return "\n".join(b.text for b in inside)


def attached(pages: DataFrame, known: DataFrame, size: Column, columns: list[str], limit: int) -> DataFrame:
    """pages (with __host) with columns of their host's row of known, null where it has none.

    known is broadcast if its counted size is within `limit` bytes; else the rows of the hosts with the most pages that
    fit are, and only pages of smaller hosts move to theirs, so that no large host meets in one task.
    """
    by = known.groupBy(F.floor(F.log2("all_pages")).alias("e")).agg(F.sum(size).alias("bytes")).collect()  # one row a power of two
    least, total = 0, 0
    for e, n in sorted(map(tuple, by), reverse=True):
        total += n
        if total > limit:
            least = 1 << (int(e) + 1)
            break
    row = F.struct(*columns)
    large = F.broadcast(known.filter(F.col("all_pages") >= least).select(F.col("host").alias("__h"), row.alias("__row")))
    found = pages.join(large, F.col("__host") == F.col("__h"), "left").drop("__h")
    if least:
        small = known.filter(F.col("all_pages") < least).select(F.col("host").alias("__h"), row.alias("__small"))
        done = found.filter("__row is not null")
        rest = found.filter("__row is null").drop("__row").join(small, F.col("__host") == F.col("__h"), "left").drop("__h")
        found = done.unionByName(rest.withColumnRenamed("__small", "__row"))
    return found.withColumns({c: F.col(f"__row.{c}") for c in columns}).drop("__row")


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", out: str = "text", limit: int = BROADCAST) -> DataFrame:
    """pages with the main text in column out; templates reach them as `attached` says."""
    known = templates(pages.select(F.col(html_col).alias("html"), F.col(url_col).alias("url")))
    known = known.select("host", "all_pages", F.struct("containers", "texts", "always", "main").alias("__template"))
    size = F.lit(64) + 16 * F.size("__template.texts") + F.length(F.array_join("__template.containers", "")) + 16 * F.size("__template.containers")
    found = attached(pages.withColumn("__host", host_of(F.col(url_col))), known, size, ["__template"], limit)

    @F.pandas_udf("string")
    def text(html: pd.Series, template: pd.DataFrame) -> pd.Series:
        held: dict = {}

        def of(page, containers, texts, always, main):
            if containers is None:
                return main_text(page)
            key = (main, texts.tobytes(), always.tobytes(), tuple(containers))
            if key not in held:
                held[key] = (frozenset(containers), frozenset(texts.tolist()), tuple(filter(None, main.split(SEP))) if main is not None else None, frozenset(always.tolist()))
            return main_text(page, *held[key])

        return pd.Series([of(*x) for x in zip(html, template["containers"], template["texts"], template["always"], template["main"])], dtype="object")

    return found.withColumn(out, text(F.col(html_col), F.col("__template"))).drop("__host", "__template")


def op3_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
