"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and texts. Streams of one host are aligned one after the other into a
wrapper: a tag that some pages lack becomes optional; siblings of the same name keep their positions while all pages that have them
have equally many, and become one repeated group as soon as two pages differ in their number; texts that differ
become slots. Alignment is associative, so partitions align their own pages first and hand on one wrapper per
host, and these are merged in two levels, the first salted, as a host may hold a third of all pages.

A host has two wrappers: one of the pages with text under an article or main element, one of the others. The first keeps all
texts under such elements; the second all slots, but for texts that are mostly links and those that all of at least
CONSTANT pages share at the same position. Both leave out what the tags or names mark as menus, headers, footers, sidebars, notices, adverts,
forms or reader comments. A name that holds such a word beside others that say nothing of layout (social-history) is judged by the wrapper:
it goes only where its texts are mostly links or the same on all pages. A page is read by matching it against its host's wrapper:
exact position, else the repeated group of that name, else the tag whose names are open.

Defined results: null html gives an empty text; pages may nest as deeply as they like; a page without host has the wrapper of all such pages; repeated rows are
read alike; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspan.llm.common import by_batch, durable
from quillspan.llm.url_filter import host_and_path

#: Pages that must share a text outside an article for it to count as the host's own.
CONSTANT = 5
#: Differently named siblings of one tag before their names count as a slot too.
NAMES = 32
#: Siblings of one name on a page that keep their positions; more are a repeated group at once.
POSITIONS = 32
#: Parts into which the partial wrappers of a host are dealt before the last merge.
SALTS = 64
#: Share of a text that may be links outside an article.
LINKED = 0.6
#: Levels of a page that have paths of their own; what is nested deeper has the path of its ancestor there, and keeps its text.
DEEP = 150
#: Bytes of kept paths up to which they are broadcast; beyond it pages are joined with them by host.
BROADCAST_BYTES = 8_000_000

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup td th time tt u var".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "option": {"select"}}
OUT_TAGS = set("head title nav footer aside form header button select textarea dialog menu".split())
OUT_NAMES = set("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer header login masthead menu meta nav navbar navigation newsletter notice notices pagination popup promo promos related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Words of layout: a name of these and a word of OUT_NAMES says what the word says.
PLAIN = set("area article articles bar block body bottom box button buttons col column container content entry global group inner item items left link links list main page panel post posts right section site text thread title top unit wrap wrapper".split())
MAIN = {"article", "main"}
MAIN_NAMES = {"articlebody"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+)|<", re.S | re.I)
_NAME = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")


def signature(tag: str, attributes: str) -> str:
    """The tag with its class, id and role, numbers left open."""
    if "=" not in attributes:
        return tag
    names = " ".join(a or b or c for a, b, c in _NAME.findall(attributes))
    return f"{tag}.{re.sub(r'[0-9]+', '#', ' '.join(names.split()))}" if names else tag


def blocks(page: str | None) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) for each text between block tags, in page order.

    A path holds names with their positions among siblings of the same name. An empty text marks an element as it opens.
    """
    path: list[str] = []
    tags: list[str] = []
    seen: list[dict[str, int]] = [{}]  # by level: how often each name came
    text: list[str] = []
    opened: Counter[str] = Counter()
    linked = in_link = 0

    def flush():
        nonlocal linked
        whole = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        got, linked = linked, 0
        return [(tuple(path[:DEEP]), whole, min(got, len(whole)))] if whole else []

    def close(at: int) -> None:
        opened.subtract(tags[at:])
        del tags[at:], path[at:], seen[at + 1 :]

    for m in _TOKEN.finditer(page or ""):
        if m[5] is not None:
            text.append(m[5])
            linked += in_link and len(m[5])
            continue
        if m[3] is None:
            if m[0] == "<":
                text.append("<")
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag in VOID:
            text.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            if tag in ("td", "th"):
                text.append(" ")
            continue
        yield from flush()
        in_link = 0
        if closing:
            if opened[tag] > 0:
                close(next(at for at in range(len(tags) - 1, -1, -1) if tags[at] == tag))
            continue
        if "p" in tags[-1:]:
            close(len(tags) - 1)
        if any(opened[t] > 0 for t in CLOSES.get(tag, ())):
            for at in range(len(tags) - 1, -1, -1):
                if tags[at] in CLOSES[tag]:
                    close(at)
                    break
                if tags[at] in SCOPE[tag]:
                    break
        if m[4].rstrip().endswith("/"):
            continue
        tags.append(tag)
        name = signature(tag, m[4])
        at = seen[-1][name] = min(seen[-1].get(name, 0), POSITIONS) + 1
        path.append(name if at == 1 else f"{name}\t{at}")
        seen.append({})
        opened[tag] += 1
        if len(tags) <= DEEP:
            yield tuple(path), "", 0
    yield from flush()


# A wrapper element is a dict: "o" some pages lack it, "r" it repeats, "g" its content is one repeated group,
# "t" its text (a constant, or True for a slot), "n" pages, "c" and "l" characters and linked characters, "k" members in order.
# Members are keyed "name" and "name\\t2", "name\\t3", ... by position, "name\\t*" as a repeated group, "tag.*" with open names.


def _element() -> dict:
    return {"o": False, "r": False, "g": False, "t": None, "n": 1, "c": 0, "l": 0, "k": {}}


def _base(key: str) -> str:
    return key.partition("\t")[0]


def wrapper_of(page: str | None) -> dict:
    """The wrapper of one page."""
    root = _element()
    for path, text, linked in blocks(page):
        here = root
        for key in path:
            member = here["k"].get(key)
            if member is None:
                member = here["k"][key] = _element()
            here = member
        if text:
            here["t"] = text if here["t"] is None or here["t"] == text else True
            here["c"] += len(text)
            here["l"] += linked
    return _settle(root)


def _settle(e: dict) -> dict:
    """Members beyond the bounds on positions and names become groups, at every level."""
    for member in e["k"].values():
        _settle(member)
    for key in [k for k in e["k"] if k.endswith(f"\t{POSITIONS + 1}")]:
        _repeat(e, _base(key))
    return _open_names(e)


def _fold(e: dict, keys: list[str], into: str) -> None:
    """The members ``keys`` of an element become one repeated member, at the place of the first."""
    at = {k: place for place, k in enumerate(e["k"])}
    if at[keys[-1]] - at[keys[0]] >= len(keys):
        e["g"] = True  # others stand between them
    one, optional = e["k"][keys[0]], all(e["k"][k]["o"] for k in keys)
    for key in keys[1:]:
        align(one, e["k"][key], same_pages=True)
    one["r"], one["o"] = True, optional
    gone = set(keys[1:])
    e["k"] = {into if k == keys[0] else k: one if k == keys[0] else m for k, m in e["k"].items() if k not in gone}


def _repeat(e: dict, name: str) -> None:
    keys = [k for k in e["k"] if _base(k) == name]
    if keys and keys != [f"{name}\t*"]:
        _fold(e, keys, f"{name}\t*")


def _counts(e: dict) -> dict[str, int]:
    """Positions by name; -1 for a repeated group."""
    out: dict[str, int] = {}
    for key in e["k"]:
        name, _, at = key.partition("\t")
        out[name] = -1 if at == "*" else out.get(name, 0) + 1
    return out


def align(a: dict, b: dict, same_pages: bool = False) -> dict:
    """The wrapper of both; ``a`` is changed and returned, ``b`` is used up. ``same_pages``: both are of the same pages."""
    if b["t"] != a["t"]:
        a["t"] = True
    a["r"] |= b["r"]
    a["g"] |= b["g"]
    a["o"] |= b["o"]
    a["n"] = max(a["n"], b["n"]) if same_pages else a["n"] + b["n"]
    a["c"] += b["c"]
    a["l"] += b["l"]
    for tag in {k[:-2] for e in (a, b) for k in e["k"] if k.endswith(".*")}:
        _open_tag(a, tag)
        _open_tag(b, tag)
    left, right = _counts(a), _counts(b)
    for name, n in left.items():
        if right.get(name, n) != n:
            _repeat(a, name)
            _repeat(b, name)
    mine, theirs = a["k"], b["k"]
    shared = [n for n in mine if n in theirs]
    if shared != [n for n in theirs if n in mine]:
        a["g"] = True  # the same members in another order
    for name, member in mine.items():
        if name in theirs:
            align(member, theirs[name], same_pages)
        else:
            member["o"] = True
    fresh = [n for n in theirs if n not in mine]
    if fresh:
        merged: dict[str, dict] = {}
        queue = deque(theirs)
        for name in mine:  # keep both orders: what stands before a shared member goes before it
            while queue and name in theirs and queue[0] != name:
                other = queue.popleft()
                if other not in mine:
                    merged[other] = theirs[other] | {"o": True}
            if queue and queue[0] == name:
                queue.popleft()
            merged[name] = mine[name]
        for other in queue:
            if other not in mine:
                merged[other] = theirs[other] | {"o": True}
        a["k"] = merged
    return _open_names(a)


def _open_tag(e: dict, tag: str) -> None:
    keys = [k for k in e["k"] if _base(k).split(".")[0] == tag]
    if keys and keys != [f"{tag}.*"]:
        _fold(e, keys, f"{tag}.*")


def _open_names(a: dict) -> dict:
    """Many differently named members of one tag become one, whose name is a slot."""
    if len(a["k"]) > NAMES:
        by_tag = Counter(name.split(".")[0] for name in {_base(k) for k in a["k"]})
        for tag, n in by_tag.items():
            if n > NAMES:
                _open_tag(a, tag)
                a["g"] = True
    return a


def expression(w: dict) -> str:
    """The wrapper as a regular expression over tags; # is a text slot."""
    text = "" if w["t"] is None else "#" if w["t"] is True else repr(w["t"])
    parts = [text] if text else []
    for key, m in w["k"].items():
        name = _base(key)
        mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[m["o"], m["r"]]
        parts.append(f"(<{name}>{expression(m)}</{name}>){mark}" if mark else f"<{name}>{expression(m)}</{name}>")
    return f"({' '.join(parts)})+" if w["g"] else " ".join(parts)


@lru_cache(100_000)
def _named_out(names: str) -> bool | None:
    """Whether one of the names marks a thing outside the article; None if a name holds such a word beside others."""
    doubt = False
    for name in names.split():
        words = set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
        if words & OUT_NAMES:
            if words <= OUT_NAMES | PLAIN:
                return True
            doubt = True
    return None if doubt else False


def _is_out(key: str, in_main: bool) -> bool:
    tag, _, names = _base(key).partition(".")
    return tag in OUT_TAGS and not (tag == "header" and in_main) or bool(_named_out(names))


def _is_main(key: str) -> bool:
    tag, _, names = _base(key).partition(".")
    return tag in MAIN or any(n in MAIN_NAMES or n == "main" and tag != "body" for n in names.lower().split())


def _same_or_linked(e: dict) -> bool:
    """Whether all texts of an element are the same on all of at least CONSTANT pages, or most of them are links."""
    found = list(_texts(e))
    chars, linked = (sum(m[c] for _, m, _ in found) for c in "cl")
    return linked > LINKED * chars or e["n"] >= CONSTANT and not any(m["t"] is True for _, m, _ in found)


def _texts(w: dict, judge: bool = False) -> Iterator[tuple[tuple[str, ...], dict, bool]]:
    """(path, element, whether it is in an article) of the elements with text that no name marks as not of the article.

    ``judge``: names in doubt are decided by the wrapper.
    """

    def walk(e: dict, path: tuple[str, ...], in_main: bool) -> Iterator[tuple[tuple[str, ...], dict, bool]]:
        if e["t"] is not None:
            yield path, e, in_main
        for key, m in e["k"].items():
            if _is_out(key, in_main) or judge and _named_out(_base(key).partition(".")[2]) is None and _same_or_linked(m):
                continue
            yield from walk(m, (*path, key), in_main or _is_main(key))

    return walk(w, (), False)


def has_article(w: dict) -> bool:
    return any(inside for _, _, inside in _texts(w))


def kept_paths(w: dict) -> list[str]:
    """Paths, joined by newlines, of the elements whose texts are the article's; the pages of ``w`` all have an article, or none has."""
    found = list(_texts(w, judge=True))
    if has_article(w):
        return ["\n".join(p) for p, _, inside in found if inside]
    return ["\n".join(p) for p, m, _ in found if m["l"] <= LINKED * m["c"] and (m["t"] is True or m["n"] < CONSTANT)]


def matcher(paths: list[str]) -> dict:
    """The paths as a tree of keys; the member "" marks an end."""
    root: dict = {}
    for path in paths:
        here = root
        for key in path.split("\n") if path else ():
            here = here.setdefault(key, {})
        here[""] = {}
    return root


def _fits(path: tuple[str, ...], tree: dict) -> bool:
    for key in path:
        found = tree.get(key)
        if found is None:
            name = _base(key)
            found = tree.get(f"{name}\t*")
            if found is None:
                found = tree.get(f"{name.partition('.')[0]}.*")
                if found is None:
                    return False
        tree = found
    return "" in tree


def main_text(found: list[tuple], tree: dict) -> str:
    """The texts of a page's blocks that fit the tree, in page order."""
    return "\n\n".join(text for path, text, _ in found if text and _fits(path, tree))


@lru_cache(100_000)
def _in_article(path: tuple[str, ...]) -> bool:
    """What has_article asks, of one text."""
    inside = False
    for name in path:
        if _is_out(name, inside):
            return False
        inside = inside or _is_main(name)
    return inside


def host_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, article, wrapper (JSON), from all pages of each host with or without an article."""
    rows = pages.select(host_and_path(F.col(url))[0].alias("host"), F.col(html).cast("string").alias("html"))
    out = pa.schema([("host", pa.string()), ("article", pa.bool_()), ("wrapper", pa.string())])

    def rows_of(known: dict[tuple, dict]) -> pa.RecordBatch:
        cols = [h for h, _ in known], [a for _, a in known], [json.dumps(w) for w in known.values()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, dict] = {}
        for batch in batches:
            for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = wrapper_of(page)
                key = host, has_article(now)
                known[key] = align(known[key], now) if key in known else now
            if len(known) > 20_000:  # many small hosts: hand on what there is
                yield rows_of(known)
                known = {}
        yield rows_of(known)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            done: dict[tuple, dict] = {}
            for host, article, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, article) == at:
                    now = align(now, json.loads(text))
                else:
                    if now is not None:
                        done[at] = now
                    at, now = (host, article), json.loads(text)
            yield rows_of(done)
        if now is not None:
            yield rows_of({at: now})

    kind = "host string, article boolean, wrapper string"
    at = ["host", "article"]
    salted = rows.mapInArrow(local, kind).repartition(*at, F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).sortWithinPartitions(*at, "wrapper").mapInArrow(merge, kind)
    return salted.repartition(*at).sortWithinPartitions(*at, "wrapper").mapInArrow(merge, kind)


_PATHS: dict[str, dict] = {}


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars."""
    wrappers = host_wrappers(pages, url, html)
    read = by_batch(wrappers, "host string, article boolean, paths string", lambda b: {"host": b.column(0), "article": b.column(1), "paths": [json.dumps(kept_paths(json.loads(w))) for w in b.column(2).to_pylist()]})
    kept = durable(read.groupBy("host").agg(F.max(F.when(F.col("article"), F.col("paths"))).alias("of_articles"), F.max(F.when(~F.col("article"), F.col("paths"))).alias("of_others")))
    size = kept.agg(F.coalesce(F.sum(F.length("host") + sum(F.coalesce(F.length(c), F.lit(0)) for c in ("of_articles", "of_others"))), F.lit(0))).first()[0]
    rows = pages.select(F.col(id_col), F.col(url).alias("url"), F.col(html).cast("string").alias("html")).withColumn("host", host_and_path(F.col("url"))[0])
    joined = rows.join(F.broadcast(kept) if size <= BROADCAST_BYTES else kept, "host", "left")

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        texts = []
        for page, *both in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            found = list(blocks(page))
            paths = both[0 if any(text and _in_article(path) for path, text, _ in found) else 1] or "[]"
            if len(_PATHS) > 5000:
                _PATHS.clear()
            known = _PATHS.get(paths)
            if known is None:
                known = _PATHS[paths] = matcher(json.loads(paths))
            texts.append(main_text(found, known))
        return {id_col: batch.column(0), "url": batch.column(1), "text": texts, "n_chars": list(map(len, texts))}

    kind = pages.schema[id_col].dataType.simpleString()
    return by_batch(joined.select(id_col, "url", "html", "of_articles", "of_others"), f"`{id_col}` {kind}, url string, text string, n_chars long", run)
