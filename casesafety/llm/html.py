"""HTML extraction by equivalence-class template deduction.

Pages of a host are taken as made from one template. Tokens are elements and blocks of text, each with its path of
elements (names, classes and ids without digits); what stands in a menu, footer and the like is left out. Tokens that
occur equally often in every page share an occurrence vector and form an equivalence class. The vector is kept as one
number, the sum over pages of the page's hash times the number of occurrences, so a host's pages are never brought
together.

A class is valid if it has ``LEAST_TOKENS`` tokens or more, of which each occurs once in a page where it occurs, in at
least ``support`` of the host's pages, and if its tokens stand in the same order in two of its pages and on average
over all. Valid classes are nested, widest first: a class whose outermost tokens stand in one slot, below one element
of the template so far, becomes part of the template; one spread over several slots does not. The template then has
elements, and fixed text between them. The main slot is an ``article`` or ``main`` element of the template, else the
smallest container of the template that holds all text that the template doesn't fix. Fixed text outside the main slot is
boilerplate, whatever its elements are called; in the main slot nothing is, so text that repeats over pages stays there.
Containers beside it that vary, too, but hold less than a ``THIN``th of the varying text that the largest holds, and no
``h1``, are thin slots (adverts, links, footers by any name): these are dropped, and don't count when the main slot is looked for.
A page without text in the main slot keeps them. Where no container below the body holds the other varying
text, the main slot is what the template leaves open between its fixed texts.
Hosts with fewer than ``FEW_PAGES`` pages are taken together by domain, and have its template. Fewer than ``LEAST_PAGES`` pages,
and pages of which less than half of the text varies (copies of one page, say), tell nothing about fixed text or thin slots;
then none is dropped.

From each page the text of its ``article`` and ``main`` elements is taken, or, without any, all but the template's fixed
text outside the main slot and its thin slots. What stands in menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or reader comments goes, by elements, roles and words of classes and ids (``_marked``). In an article such
words count only where the whole name is made of them and, for words of navigation, most of the text is links:
``related-work`` or ``social-science`` stay. Nothing else is dropped.

Null or empty pages give an empty text. Reading a page takes time and memory in proportion to it, however deep or
broken its markup; a tag that never ends takes the rest of the page with it. Rows that repeat are extracted each;
null and odd addresses share the host ''. Ties between slots go by text, then by token. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .language import address_parts
from .markup import scan

LEAST_TOKENS, LEAST_PAGES, FEW_PAGES, THIN = 2, 3, 5, 12
#: Hosts whose numbers of pages are broadcast, at most.
BROADCAST_HOSTS = 200_000
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that have no end tag; elements that may stand within a block of text; elements that end an open one of the same kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS = {k: frozenset(v.split()) for k, v in {"li": "li", "tr": "tr td th", "td": "td th", "th": "td th", "dt": "dt dd", "dd": "dt dd", "option": "option"}.items()}
#: Elements that end an open paragraph; elements that hold other blocks, among which the main slot is looked for.
_P = frozenset(("p",))
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
HOLDERS = frozenset("html body div section article main center table tbody tr td".split())
MAIN, WHOLE = frozenset(("article", "main")), frozenset(("html", "body"))
#: Elements and roles that are never main text.
OUT = frozenset("head nav footer aside form button select dialog menu".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words in class or id: of furniture; of a page's head; of navigation, which also occur as words of a subject.
FURNITURE = frozenset("footer sidebar complementary contentinfo breadcrumb breadcrumbs ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent popup modal alert notice notices notification newsletter subscribe subscription comment comments commentlist disqus reply replies respond".split())
HEADS = frozenset("header masthead banner".split())
LINKS = frozenset("nav navbar navigation menu promo share sharing social related recommended widget search login signup aside pagination".split())
#: Words that go with those above in a name without giving it another subject.
NEUTRAL = frozenset("area articles bar block blog body box buttons button container content global icons inner items item left links link list main media newest page pages post posts primary reader right secondary section site slot story stories text top bottom unit user wrap wrapper your".split())

#: Words of a name that says what is beside or missing.
ABSENT = frozenset("has no not with without".split())


@lru_cache(maxsize=8192)
def _marked(attributes: str) -> tuple[str, bool, bool, bool, bool, str]:
    """(label, furniture, furniture in an article too, head, navigation, role) of a tag's attributes; navigation: a word of ``LINKS`` is there."""
    label, hard, strict, head, links, known, role = [], False, False, False, False, False, ""
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if key.lower() == "role":
            role = value.strip()
            continue
        for name in value.split():
            parts = [p for p in re.split(r"[^a-z]+", name) if p]
            label.append(re.sub(r"[0-9]+", "", name))
            if ABSENT.intersection(parts):
                continue
            here = FURNITURE.intersection(parts)
            whole = all(p in FURNITURE or p in HEADS or p in LINKS or p in NEUTRAL for p in parts)
            hard, strict = hard or bool(here), strict or bool(here) and whole
            head = head or bool(HEADS.intersection(parts))
            if LINKS.intersection(parts):
                links, known = True, known or whole
    return ".".join(sorted(set(label))), hard or known, strict, head, links, role


class Page:
    """A page's nodes in order of their start, and its blocks of text.

    A node has its name, the number of its parent, and the hash of its path. Inline elements are no nodes unless
    something marks them; these have their parent's path.
    """

    def __init__(self, html: str):
        self.name, self.parent, self.token, self.element, self.main = [""], [-1], [0], [True], [False]
        self._hard, self._links = [False], [False]
        self.blocks: list[tuple[int, str, int, bool, int]] = []  # node, raw text, characters of it in links, whether a space stands before it, nodes so far
        self._read(html)
        self._settle()

    def _read(self, html: str) -> None:
        # name, node, place of the nearest entry that is no inline element, whether an article is open
        stack: list[tuple[str, int, int, bool]] = []
        open_: dict[str, int] = {}
        text: list[str] = []
        linked, space = 0, True

        def flush(gap: bool) -> None:
            nonlocal linked, space
            if text:
                self.blocks.append((stack[-1][1] if stack else 0, "".join(text), linked, space, len(self.name)))
                text.clear()
                space = False
            linked, space = 0, space or gap

        def cut(k: int) -> None:
            for entry in stack[k:]:
                open_[entry[0]] -= 1
            del stack[k:]

        for piece, name, attributes, closing in scan(html):
            if piece:
                text.append(piece)
                if open_.get("a"):
                    linked += len(piece.strip())
            if not name:
                continue
            if closing:
                if not open_.get(name):
                    continue
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if name not in INLINE:
                    flush(True)
                elif any(e[1] != (stack[k - 1][1] if k else 0) for e in stack[k:]):
                    flush(False)
                cut(k)
                continue
            inline = name in INLINE
            if not inline:
                ended = ENDS.get(name) or (_P if name in ENDS_P else None)
                if ended and any(open_.get(e) for e in ended):
                    k = stack[-1][2] if stack else -1
                    while k >= 0 and stack[k][0] not in ended and stack[k][0] == "p":
                        k = stack[k - 1][2] if k else -1
                    if k >= 0 and stack[k][0] in ended:  # an open one ends, unless another block stands between
                        flush(True)
                        cut(k)
                if name in VOID:
                    if name in ("br", "hr"):
                        flush(True)
                    continue
                flush(True)
            elif name in VOID:
                continue
            node, inside = (stack[-1][1], stack[-1][3]) if stack else (0, False)
            label, hard, strict, head, links, role = _marked(attributes) if len(attributes) < 1000 else _marked.__wrapped__(attributes)
            main = name in MAIN or role in MAIN
            gone = strict if inside or main else hard and name not in ("html", "body")
            if not inline:
                gone = gone or name in OUT or role in OUT_ROLES or (name == "header" or head and name not in ("html", "body")) and not inside and not main
            if not inline or gone:
                if inline:
                    flush(False)
                self.name.append(name)
                self.parent.append(node)
                path = self.token[node]
                self.token.append(path if inline else xxhash.xxh64_intdigest(f"{name} {label}".encode("utf-8", "surrogatepass"), path & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                self.element.append(not inline)
                self.main.append(main and not gone)
                self._hard.append(gone)
                self._links.append(links and not inline)
                node = len(self.name) - 1
            if not attributes.endswith("/"):
                k = len(stack)
                stack.append((name, node, (stack[-1][2] if stack else -1) if inline else k, inside or main))
                open_[name] = open_.get(name, 0) + 1
        flush(True)

    def _settle(self) -> None:
        """Which nodes are out, and how much text and link text each has in and below it."""
        n = len(self.name)
        chars, linked = [0] * n, [0] * n
        for node, text, in_links, _, _ in self.blocks:
            chars[node] += len(text.strip())
            linked[node] += in_links
        all_chars = list(chars)
        for k in range(n - 1, 0, -1):
            all_chars[self.parent[k]] += all_chars[k]
            linked[self.parent[k]] += linked[k]
        self.out = [False] * n
        for k in range(1, n):
            self.out[k] = self._hard[k] or self.out[self.parent[k]] or self._links[k] and 2 * linked[k] >= all_chars[k]
        self.chars = [0 if out else c for c, out in zip(chars, self.out, strict=True)]
        for k in range(n - 1, 0, -1):
            self.chars[self.parent[k]] += self.chars[k]

    def block_token(self, node: int, text: str) -> int:
        return xxhash.xxh64_intdigest(" ".join(text.split()).encode("utf-8", "surrogatepass"), (self.token[node] + 1) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)

    def tokens(self) -> dict[int, list]:
        """token -> [parent's token, name ('' for text), occurrences, first place, characters]; token 0 is the page itself."""
        found: dict[int, list] = {0: [0, "", 1, 0, self.chars[0]]}

        def add(token: int, parent: int, name: str, place: int, chars: int) -> None:
            if (t := found.get(token)) is None:
                found[token] = [parent, name, 1, place, chars]
            else:
                t[2] += 1
                t[4] += chars

        place, at = 0, 0
        blocks = [b for b in self.blocks if not self.out[b[0]] and b[1].strip()]
        for k in range(1, len(self.name) + 1):
            while at < len(blocks) and blocks[at][4] <= k:
                node, text = blocks[at][:2]
                place, at = place + 1, at + 1
                add(self.block_token(node, text), self.token[node], "", place, len(text.strip()))
            if k < len(self.name) and self.element[k] and not self.out[k]:
                place += 1
                add(self.token[k], self.token[self.parent[k]], self.name[k], place, self.chars[k])
        return found

    def text(self, slot: int, fixed: frozenset[int], thin: frozenset[int] = frozenset()) -> str:
        """Main text: that of the page's articles, else all but the elements ``thin`` and ``fixed`` text outside the element ``slot``."""
        n = len(self.name)
        beside = [False] * n
        tops = [self.main[k] and not self.out[k] for k in range(n)]
        named = any(tops)
        if not named:
            tops = [slot != 0 and self.element[k] and self.token[k] == slot for k in range(n)]
            if any(top and self.chars[k] for k, top in enumerate(tops)):
                beside = [self.element[k] and self.token[k] in thin for k in range(n)]
        for k in range(1, n):
            tops[k] = tops[k] or tops[self.parent[k]]
            beside[k] = beside[k] or beside[self.parent[k]]
        parts = []
        for node, text, _, space, _ in self.blocks:
            if space:
                parts.append(" ")
            if not self.out[node] and not beside[node] and (tops[node] or not named and (not fixed or self.block_token(node, text) not in fixed)):
                parts.append(text)
        return " ".join(unescape("".join(parts)).split())


def _host(url):
    """The host of an address; null or strange addresses share the host ''."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


_PRIME = (1 << 61) - 1


def _added_up(tokens: DataFrame) -> DataFrame:
    """``occurrences`` of one host and token added up."""
    total = F.pmod(F.sum(F.col("vector").cast("decimal(38,0)")), F.lit(_PRIME).cast("decimal(38,0)")).cast("long")
    sums = tokens.groupBy("host", "token").agg(
        F.min("parent").alias("parent"), F.min("name").alias("name"), total.alias("vector"), F.sum("pages").alias("pages"), F.max("most").alias("most"), F.sum("chars").alias("chars"),
        F.min(F.struct("low_key", "low")).alias("first"), F.max(F.struct("high_key", "high")).alias("last"), F.sum("places").alias("places"),
    )
    return sums.select("host", "token", "parent", "name", "vector", "pages", "most", "chars", "first.*", "last.*", "places")


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, parent, name, vector, pages, most, chars, low_key, low, high_key, high, places) for each token of each host.

    low and high: the token's place in the page of the smallest and of the largest hash (low_key, high_key) that has it; places: the sum of
    its places. Each batch is summed up before it is shuffled.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums: dict[tuple[str, int], list] = {}
            for host, key, html in zip(b["host"], b["key"], b["html"], strict=True):
                for token, (parent, name, n, place, chars) in Page(html or "").tokens().items():
                    s = sums.get((host, token))
                    if s is None:
                        sums[host, token] = [parent, name, key * n % _PRIME, 1, n, chars, key, place, key, place, place]
                        continue
                    s[2] = (s[2] + key * n) % _PRIME
                    s[3] += 1
                    s[4] = max(s[4], n)
                    s[5] += chars
                    if key < s[6]:
                        s[6:8] = key, place
                    if key > s[8]:
                        s[8:10] = key, place
                    s[10] += place
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["host", "token", "parent", "name", "vector", "pages", "most", "chars", "low_key", "low", "high_key", "high", "places"])

    keyed = pages.select(_host(F.col("url")).alias("host"), F.pmod(F.xxhash64("page_id", "url"), F.lit(_PRIME)).alias("key"), F.col("html").cast("string"))
    part = keyed.mapInPandas(count, "host string, token long, parent long, name string, vector long, pages long, most long, chars long, low_key long, low long, high_key long, high long, places long")
    return _added_up(part)


def _in_order(cls: pd.DataFrame) -> bool:
    by_low = cls.sort_values("low")
    return bool((np.diff(by_low["high"]) > 0).all() and (np.diff(by_low["places"]) > 0).all())


def _template(pdf: pd.DataFrame) -> tuple[int, str, list[int], list[int]]:
    """(slot, 0 for the page as a whole; its path of names; fixed text outside it; thin slots beside it) from a host's frequent tokens; a host's template has at most 1 / support times the tokens of an average page."""
    parent, name, chars = (dict(zip(pdf["token"], pdf[c], strict=True)) for c in ("parent", "name", "chars"))
    in_template, fixed = {0}, set()

    def above(token: int, mine: set[int]) -> int:
        """The nearest element above the token that is in the template or in ``mine``."""
        token = parent[token]
        while token not in in_template and token not in mine:
            token = parent.get(token, 0)
        return token

    once = pdf[(pdf["most"] == 1) & (pdf["token"] != 0)]
    classes = [c for _, c in once.groupby("vector") if len(c) >= LEAST_TOKENS and _in_order(c)]
    for cls in sorted(classes, key=lambda c: (-c["pages"].iloc[0], -len(c), c["token"].min())):
        mine = set(cls["token"])
        outer = {a for t in mine if (a := above(t, mine)) not in mine}
        if len(outer) == 1:  # the class fits in one slot
            in_template |= {t for t in mine if name[t]}
            fixed |= {t for t in mine if not name[t]}
    depth = {0: 0}
    for t in parent:  # each token is climbed from once
        climbed = []
        while t not in depth:
            climbed.append(t)
            t = parent.get(t, 0)
        depth |= {c: depth[t] + k + 1 for k, c in enumerate(reversed(climbed))}
    downwards = sorted(depth, key=lambda t: (depth[t], t))
    fixed_chars = dict.fromkeys(depth, 0) | {t: chars[t] for t in fixed}
    for t in reversed(downwards[1:]):
        fixed_chars[parent.get(t, 0)] += fixed_chars[t]
    varying = {t: chars[t] - fixed_chars[t] for t in in_template}
    told = pdf["pages"].max() >= LEAST_PAGES and 2 * varying[0] >= chars[0]
    if not told:
        varying, fixed = chars, set()
    named = [t for t in in_template if name[t] in MAIN]
    slot = max(named, key=lambda t: (varying[t], t)) if named else 0
    below: dict[int, list[int]] = {}
    for t in in_template - {0}:
        below.setdefault(above(t, set()), []).append(t)
    titled: set[int] = set()
    for t in (t for t in parent if name[t] == "h1"):
        while t and t not in titled:
            titled.add(t)
            t = parent.get(t, 0)
    thin: set[int] = set()
    while not named:
        holders = [t for t in below.get(slot, ()) if name[t] in HOLDERS]
        largest = max(holders, key=lambda t: (varying[t], t), default=0)
        beside = {t for t in holders if told and t not in titled and THIN * varying[t] < varying[largest]}
        if not largest or not 0 < varying[largest] == varying[slot] - sum(varying[t] for t in beside):
            break
        slot = largest
        thin |= beside
    path, t = [], slot
    while t:
        path.append(name[t])
        t = parent.get(t, 0)
    slot = 0 if name[slot] in WHOLE else slot
    inside: set[int] = set()
    for t in downwards[1:]:
        if t == slot or parent.get(t, 0) in inside:
            inside.add(t)
    return slot, "/".join(reversed(path)), sorted(fixed - inside), sorted(thin)


def deduce(tokens: DataFrame, support: float = 0.5) -> DataFrame:
    """(host, slot, path, fixed, thin) from ``occurrences``: each host's main slot, the fixed text outside it and the thin slots beside it."""
    total = tokens.where("token = 0").select("host", F.col("pages").alias("host_pages"))
    # By broadcast, unless there are very many hosts, so that a host's rare tokens are not brought together.
    small = total.count() <= BROADCAST_HOSTS
    near = lambda df: F.broadcast(df) if small else df
    known = tokens.join(near(total), "host")
    domain = address_parts(F.concat(F.lit("http://"), F.col("host")))[1]
    few = total.where(F.col("host_pages") < FEW_PAGES).select("host", F.concat(F.lit("/"), domain).alias("domain"))
    together = _added_up(tokens.join(near(few), "host").drop("host").withColumnRenamed("domain", "host"))
    whole = together.where("token = 0").select("host", F.col("pages").alias("host_pages"))
    known = known.where(F.col("host_pages") >= FEW_PAGES).unionByName(together.join(near(whole), "host"))
    frequent = known.where(F.col("pages") >= support * F.col("host_pages")).drop("host_pages")

    def nest(pdf: pd.DataFrame) -> pd.DataFrame:
        slot, path, fixed, thin = _template(pdf)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "slot": [slot], "path": [path], "fixed": [fixed], "thin": [thin]})

    found = staged(frequent.groupBy("host").applyInPandas(nest, "host string, slot long, path string, fixed array<long>, thin array<long>"), "deduced")
    own = found.where(~F.col("host").startswith("/"))
    return own.unionByName(few.join(found.withColumnRenamed("host", "domain"), "domain").drop("domain"))


def templates(pages: DataFrame, support: float = 0.5) -> DataFrame:
    """(host, slot): the path of each host's main slot, as names of elements."""
    return deduce(staged(occurrences(pages), "tokens"), support).select("host", F.col("path").alias("slot"))


def extract(pages: DataFrame, support: float = 0.5, broadcast_tokens: int = 200_000, deduced: DataFrame | None = None) -> DataFrame:
    """``pages`` (page_id, url, html) as (page_id, url, text, n_chars).

    ``deduced``: templates from ``deduce``, if they are there already. Templates are joined by host, by broadcast if they are at
    most ``broadcast_tokens`` hosts, fixed texts and thin slots.
    """
    found = staged(deduce(staged(occurrences(pages), "tokens"), support), "templates") if deduced is None else deduced
    size = found.agg(F.coalesce(F.sum(F.size("fixed") + F.size("thin") + 1), F.lit(0))).first()[0]
    found = F.broadcast(found) if size <= broadcast_tokens else found

    @F.pandas_udf("string")
    def text(html: pd.Series, slot: pd.Series, fixed: pd.Series, thin: pd.Series) -> pd.Series:
        known = lambda tokens: frozenset() if tokens is None else frozenset(tokens)
        return pd.Series([Page(h or "").text(int(s), known(f), known(t)) for h, s, f, t in zip(html, slot, fixed, thin, strict=True)], dtype=object)

    joined = pages.select("page_id", "url", F.col("html").cast("string"), _host(F.col("url")).alias("host")).join(found.select("host", "slot", "fixed", "thin"), "host", "left")
    done = joined.select("page_id", "url", text("html", F.coalesce("slot", F.lit(0).cast("long")), "fixed", "thin").alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
