"""Pages as trees: HTML and plain (or Markdown) text become nodes with a parent, features and, for leaves, the lines they show.

HTML gives the DOM: containers, and leaves that hold text. Text gives a tree too: page, widgets (a heading of related links or comments and
what follows it), groups (lines without a blank line between), lines. Trees of many pages are kept in flat arrays, so that messages pass
through all of them at once. Whole texts are read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick

from weftline.llm import furniture as fu

KINDS = list(fu.PHRASES)
_NAMES = (
    ["bias", "container", "page"]
    + [f"has_{k}" for k in KINDS] + [f"is_{k}" for k in KINDS]
    + ["sentence", "sentences", "long", "very_long", "title_like", "tiny", "separators", "all_link", "some_link", "comment_like", "heading", "top_heading"]
    + ["star", "dash", "numbered", "quote", "row", "code", "upper", "known_title", "after_path", "no_letters", "site_line", "date_line", "in_script"]
    + [f"tag_{t}" for t in "p li small span div td h pre blockquote a other".split()]
    + ["tag_furniture", "tag_body", "name_furniture", "name_body", "name_opaque", "links_many", "links_some", "links_none", "words_many", "words_few", "widget", "early", "late", "before_body", "after_body"]
)
FEATURE = {n: i for i, n in enumerate(_NAMES)}
N_FEATURES = len(_NAMES)
#: The share of a line that several phrases of a kind must cover to make it one of that kind.
SEVERAL = 0.08
#: Kinds of edges, by the kind of the child: each has its own parent-child potential.
EDGES = ["root", "container", "leaf", "group", "line", "widget", "governed"]
EDGE = {n: i for i, n in enumerate(EDGES)}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    where: dict[str, set[int]] = {}
    for k, kind in enumerate(KINDS):
        for p in fu.phrases(kind):
            where.setdefault(p.replace("¦", "|"), set()).add(k)
    for p, kinds in where.items():
        a.add_word(p, (p, len(p), tuple(kinds)))
    a.make_automaton()
    return a


_FIND = _automaton()
_MENU, _MENU_KIND = frozenset(fu.phrases("menu")), KINDS.index("menu")
_COMMENT = re.compile(r"(?:[^\W\d_]\.\s?){0,2}[^\W\d_][\w'’-]{1,20}(?: [^\W\d_][\w'’-]{1,20})? ?: \S")
_LINK = re.compile(r"!?\[([^\]]*)\]\([^)\s]*\)")
_MARK = re.compile(r"\s*(?:(#{1,6})\s|([*•+])\s+|(-)\s+|(\d{1,3}[.)])\s+|(>)|(\|))")
_MARKS = frozenset("#*•+->|0123456789 \t")
_SEPARATED = re.compile(r"\s[|·/>›»•]\s")
_SPLIT_MENU = re.compile(r"\s*[|·/>›»•]\s*")
_SEPARATORS = "|·/>›»•"
_ENDS, _CLOSERS = frozenset(".!?…"), "\"'”’»)]"
_STOPS = re.compile(r"[.!?…][\"'”’»)]*\s")
_DATE = re.compile(r"\b\d{1,2}\.? [^\W\d_]{3,10}$|\b(?:19|20)\d\d\b.{0,40}$")
_WORD = re.compile(r"[^\W_]")
_LETTER = re.compile(r"[^\W\d_]")

F_ = FEATURE
_BIAS, _CONTAINER, _CODE, _HEADING, _TOP_HEADING, _QUOTE, _ALL_LINK, _SOME_LINK, _KNOWN_TITLE, _TAG_OTHER = (F_[x] for x in "bias container code heading top_heading quote all_link some_link known_title tag_other".split())
_LEAF, _GOVERNED, _GROUP, _LINE = (EDGE[x] for x in ("leaf", "governed", "group", "line"))
_MARK_FEATURES = (F_["heading"], F_["star"], F_["dash"], F_["numbered"], F_["quote"], F_["row"])
_memo: dict[str, tuple[tuple[int, ...], str]] = {}
#: What a line is to the lines around it (bits).
_AT_PATH, _AT_RELATED, _AT_COMMENTS, _IN_RELATED, _IN_COMMENTS, _AT_HEADING, _OF_FURNITURE = (1 << i for i in range(7))


@dataclass
class Trees:
    """Nodes of many pages. A parent comes before its children."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    edge: list[int] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    #: (page, line, node): a line shows visible letters or digits of a leaf
    lines: list[tuple[int, int, int]] = field(default_factory=list)
    #: the text of each leaf, by node
    text: dict[int, str] = field(default_factory=dict)
    #: pages that are data (JSON): they have no nodes
    data: set[int] = field(default_factory=set)

    def add(self, page: int, parent: int, edge: int, features: list[int]) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.edge.append(edge)
        self.features.append(features)
        return len(self.page) - 1


def line_features(raw: str) -> tuple[tuple[int, ...], str]:
    """Features of a line by its words alone, and its plain text without marks and links."""
    known = _memo.get(raw)
    if known is not None:
        return known
    out = [F_["bias"]]
    text = raw
    m = _MARK.match(text) if text[:1] in _MARKS else None
    if m:
        out.append(_MARK_FEATURES[m.lastindex - 1])
        text = text[m.end() :]
    if "](" in text:
        out.append(F_["some_link"] if _WORD.search(_LINK.sub(" ", text)) else F_["all_link"])
        text = _LINK.sub(r"\1", text)
    plain = " ".join(text.split())
    low = plain.lower()
    n = len(low)
    words = low.count(" ") + 1
    separated = any([c in low for c in _SEPARATORS])
    hits: dict[int, int] = {}
    named: dict[int, set[str]] = {}
    for _, (phrase, size, kinds) in _FIND.iter(low):
        for k in kinds:
            hits[k] = hits.get(k, 0) + size
            named.setdefault(k, set()).add(phrase)
    menu_parts = [p for p in _SPLIT_MENU.split(low) if p] if separated else [low]
    menu = sum(p in _MENU for p in menu_parts) if _MENU_KIND in hits else 0
    for k, size in hits.items():
        kind = KINDS[k]
        if kind == "menu" or kind == "byline" and words > 10:
            continue
        out.append(F_["has_" + kind])
        # much of the line, or several of the kind's phrases, which running text seldom brings together
        if size >= 0.3 * n or len(named[k]) > 1 and size >= SEVERAL * n or kind in ("byline", "path") and words <= 9:
            out.append(F_["is_" + kind])
    if menu:
        out.append(F_["has_menu"])
        if menu >= 0.5 * len(menu_parts):
            out.append(F_["is_menu"])
    ends = plain.rstrip(_CLOSERS)[-1:] in _ENDS
    stops = words > 12 and (". " in plain or "? " in plain or _STOPS.search(plain) is not None)
    if ends and words >= 4:
        out.append(F_["sentence"])
    if stops:
        out.append(F_["sentences"])
    if words >= 10:
        out.append(F_["long"])
    if words >= 25:
        out.append(F_["very_long"])
    if words <= 2:
        out.append(F_["tiny"])
    elif words <= 12 and (not ends or plain.endswith("?")):
        out.append(F_["title_like"])
    if m and m.lastindex == 6:
        pass
    elif separated and len(_SEPARATED.findall(plain)) >= 2 or (len(menu_parts) > 2 and n < 40 * len(menu_parts)):
        out.append(F_["separators"])
    if words <= 40 and _COMMENT.match(plain):
        out.append(F_["comment_like"])
    if n > 6 and plain.isupper():
        out.append(F_["upper"])
    if words <= 8 and not ends and _DATE.search(plain):
        out.append(F_["date_line"])
    if not _LETTER.search(plain):
        out.append(F_["no_letters"])
    result = (tuple(out), plain)
    if n < 160:
        if len(_memo) > 100_000:
            _memo.clear()
        _memo[raw] = result
    return result


_RELATED, _COMMENTS = F_["is_related"], F_["is_comments"]
_HEAD_STOP = {F_["heading"], F_["quote"], F_["row"], F_["star"], F_["numbered"], F_["code"]}
_FURNITURE_LINE = {F_["is_" + k] for k in KINDS}
_LINK_LIKE = {F_["title_like"], F_["tiny"], F_["all_link"]}


@lru_cache(50_000)
def _line_kind(f: tuple[int, ...], short: bool, shorter: bool) -> int:
    """What a line of such features is to those around it; short, shorter: it has at most 60, 40 characters."""
    furniture, sentence, heading = not _FURNITURE_LINE.isdisjoint(f), F_["sentence"] in f, F_["heading"] in f
    kind = heading * _AT_HEADING | furniture * _OF_FURNITURE | (F_["is_path"] in f) * _AT_PATH | (F_["comment_like"] in f) * _IN_COMMENTS
    if _RELATED in f and not sentence and not heading and short:
        kind |= _AT_RELATED
    if _COMMENTS in f and not sentence and not kind & _IN_COMMENTS and shorter:
        kind |= _AT_COMMENTS
    if not furniture and _HEAD_STOP.isdisjoint(f) and not _LINK_LIKE.isdisjoint(f):
        kind |= _IN_RELATED
    return kind


def add_text_page(t: Trees, page: int, text: str) -> None:
    """A page of plain text or Markdown."""
    root = t.add(page, -1, EDGE["root"], [F_["bias"], F_["page"]])
    widget, kind, group, fence = -1, 0, -1, False
    tail, path_before, last = "", 0, 0
    first = len(t.page)
    widget_edge, widget_features = EDGE["widget"], [_BIAS, _CONTAINER, F_["widget"]]
    for no, raw in enumerate(text.split("\n")):
        if not raw or raw.isspace():
            group = -1
            continue
        if "```" in raw and raw.lstrip()[:3] == "```":
            fence = not fence
            group = group if fence else -1
            continue
        if not _WORD.search(raw):
            continue
        if fence:
            f, plain, of = (_BIAS, _CODE), raw, 0
        else:
            f, plain = line_features(raw)
            of = _line_kind(f, len(plain) <= 60, len(plain) <= 40)
        own = list(f)
        named = False
        if of & _AT_PATH:
            tail = _SPLIT_MENU.split(plain)[-1].strip().lower()
        elif tail and plain.lower() == tail:
            own.append(_KNOWN_TITLE)
            named = True
        # does the line begin, go on with, or end a widget?
        if of & _AT_RELATED:
            widget, kind, group = t.add(page, root, widget_edge, list(widget_features)), _IN_RELATED, -1
        elif of & _AT_COMMENTS:
            widget, kind, group = t.add(page, root, widget_edge, list(widget_features)), _IN_COMMENTS, -1
        elif widget >= 0 and (not of & kind or named and kind == _IN_RELATED):
            widget, kind, group = -1, 0, -1
        if widget >= 0:
            node = t.add(page, widget, _GOVERNED, own)
        else:
            # a heading begins a group of its own, and so does a change between plain furniture and other lines
            kinds = of & (_AT_HEADING | _OF_FURNITURE)
            if group < 0 or kinds != last:
                last = kinds
                group = t.add(page, root, _GROUP, [_BIAS, _CONTAINER])
            node = t.add(page, group, _LINE, own)
        if path_before:
            own.append(F_["after_path"])
        path_before = of & _AT_PATH
        t.text[node] = plain
        t.lines.append((page, no, node))
    _positions(t, first)


_BODYISH = {F_["sentences"], F_["very_long"], F_["code"]}


_SENTENCE, _LONG = F_["sentence"], F_["long"]


def _positions(t: Trees, first: int) -> None:
    """Where leaves stand: before the first and after the last passage of running text, early and late."""
    features = t.features
    leaves = [i for i in range(first, len(t.page)) if i in t.text]
    n = len(leaves)
    lo, hi = n, -1
    for j, i in enumerate(leaves):
        f = features[i]
        if not _BODYISH.isdisjoint(f) or (_SENTENCE in f and _LONG in f and _FURNITURE_LINE.isdisjoint(f)):
            lo, hi = min(lo, j), j
    if hi >= 0:
        for i in leaves[:lo]:
            features[i].append(F_["before_body"])
        for i in leaves[hi + 1 :]:
            features[i].append(F_["after_body"])
    for j, i in enumerate(leaves):
        if j < 0.15 * n:
            features[i].append(F_["early"])
        elif j > 0.85 * n:
            features[i].append(F_["late"])


#: What shows nothing, whatever is in it; and a tag, outside of which all is text.
_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_HIDES = re.compile(r"<(?:!--|script|style|template|textarea)", re.I)
_TAG = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9-]*|[!?])([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>")
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a b i em strong u s code span small sub sup mark abbr cite q time kbd samp var font label big tt del ins bdi bdo data dfn".split())
_CONTAINERS = frozenset("html body div td th section article main nav footer aside header ul ol table tbody thead tfoot tr dl form figure details center fieldset noscript menu dialog".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_STOP_AT = frozenset("ul ol table div td section main article nav aside footer body html blockquote".split())
_TAG_FEATURE = {t: F_["tag_" + t] for t in "p li small span div td pre blockquote a".split()} | {f"h{i}": F_["tag_h"] for i in range(1, 7)}
_OPAQUE = re.compile(r"[a-z]{0,2}[0-9a-z]{3,10}")
#: Containers that have no node of their own.
_PLAIN = frozenset("html body tr tbody thead tfoot".split())
_IS_VOID, _IS_INLINE, _IS_CONTAINER, _IS_BLOCK = 1, 2, 3, 4
_names: dict[str, list[int]] = {}
_tags: dict[str, tuple[bool, str, int]] = {}


def _tag_kind(name: str) -> tuple[bool, str, int]:
    """Of a tag as written: whether it closes, its name, and of which kind it is; 0: it shows nothing."""
    tag = name.lstrip("/").lower()
    if len(_tags) > 10_000:
        _tags.clear()
    if tag in ("!", "?", ""):
        return False, "", 0
    return name[0] == "/", tag, _IS_VOID if tag in _VOID else _IS_INLINE if tag in _INLINE else _IS_CONTAINER if tag in _CONTAINERS else _IS_BLOCK


def _name_features(attributes: str) -> list[int]:
    known = _names.get(attributes)
    if known is None:
        value = " ".join(a or b or c for a, b, c in _ATTR.findall(attributes)).lower()
        known = []
        if value:
            if any(n in value for n in fu.FURNITURE_NAMES):
                known.append(F_["name_furniture"])
            if any(n in value for n in fu.BODY_NAMES):
                known.append(F_["name_body"])
            if not known and _OPAQUE.fullmatch(value) and any(c.isdigit() for c in value):
                known.append(F_["name_opaque"])
        if len(_names) > 20_000:
            _names.clear()
        _names[attributes] = known
    return known


def add_html_page(t: Trees, page: int, text: str) -> None:
    """A page of HTML. Head, scripts, styles and comments show nothing; the title only names the page."""
    root = t.add(page, -1, EDGE["root"], [F_["bias"], F_["page"]])
    first = len(t.page)
    stack: list[tuple[str, int]] = []  # open tags and the container node in force
    current, leaf_tag = root, ""
    parts: list[str] = []
    spans: list[int] = []  # the lines of the leaf so far
    linked = 0
    title, in_head, in_title, in_link, in_pre, quoted = "", False, False, 0, 0, False
    no, was_br = 0, False
    counts: dict[int, list[int]] = {}

    def flush() -> None:
        nonlocal parts, spans, linked
        if spans:
            whole = "".join(parts)
            if "&" in whole:
                whole = html.unescape(whole)
            if _WORD.search(whole):
                if in_pre:
                    fs, plain = [_BIAS, _CODE], whole
                else:
                    f, plain = line_features(" ".join(whole.split()))
                    fs = list(f)
                fs.append(_TAG_FEATURE.get(leaf_tag, _TAG_OTHER))
                if leaf_tag[:1] == "h" and leaf_tag[1:].isdigit():
                    fs.append(_HEADING)
                    if leaf_tag == "h1":
                        fs.append(_TOP_HEADING)
                if quoted:
                    fs.append(_QUOTE)
                if linked:
                    fs.append(_ALL_LINK if linked >= 0.8 * len(plain) else _SOME_LINK)
                if title and len(plain) > 3 and title.startswith(plain.lower()):
                    fs.append(_KNOWN_TITLE)
                node = t.add(page, current, _LEAF, fs)
                t.text[node] = plain
                for at in spans:
                    t.lines.append((page, at, node))
                words = plain.count(" ") + 1
                k = counts.get(current)
                if k is None:
                    k = counts[current] = [0, 0]
                k[0] += words
                k[1] += words if linked else 0
            spans = []
        parts, linked = [], 0

    if _HIDES.search(text):
        text = _UNSEEN.sub(lambda m: "\n" * m.group().count("\n"), text)
    pieces = _TAG.split(text)
    pieces[:0] = ("!", "")  # what comes before the first tag
    for name, attributes, chunk in zip(pieces[0::3], pieces[1::3], pieces[2::3]):
        known = _tags.get(name)
        if known is None:
            known = _tags[name] = _tag_kind(name)
        slash, tag, kind = known
        after_br, was_br = was_br, tag == "br"
        if not kind:
            pass
        elif slash:
            if tag == "head":
                in_head = False
            elif tag == "title":
                in_title = False
                title = " ".join(title.lower().split())
            elif tag == "a":
                in_link = max(0, in_link - 1)
            if kind == _IS_INLINE:
                if leaf_tag == tag and tag in ("span", "small") and (not stack or stack[-1][0] in _CONTAINERS):
                    flush()
                    leaf_tag = ""
            else:
                if parts:
                    flush()
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        for closed, _ in stack[depth:]:
                            if closed == "pre":
                                in_pre -= 1
                            elif closed == "blockquote":
                                quoted = False
                        del stack[depth:]
                        break
                if stack:
                    top, current = stack[-1]
                    leaf_tag = "" if top in _CONTAINERS else top
                else:
                    current, leaf_tag = root, ""
        else:
            if kind == _IS_INLINE:
                if tag == "a":
                    in_link += 1
                elif tag in ("span", "small") and not "".join(parts).strip() and (not stack or stack[-1][0] in _CONTAINERS):
                    flush()
                    leaf_tag = tag
            elif kind == _IS_VOID:
                if was_br:
                    if after_br:
                        flush()
                    elif parts:
                        parts.append(" ")
            else:
                if tag == "head":
                    in_head = True
                elif tag == "body":
                    in_head = in_title = False
                elif tag == "title" and not title:
                    in_title = True
                if parts:
                    flush()
                closes = _CLOSES.get(tag)
                if closes:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in closes:
                            del stack[k:]
                            break
                        if stack[k][0] in _STOP_AT:
                            break
                    current = stack[-1][1] if stack else root
                if kind == _IS_CONTAINER:
                    if tag not in _PLAIN:
                        fs = [_BIAS, _CONTAINER, *_name_features(attributes)] if attributes else [_BIAS, _CONTAINER]
                        if tag in fu.FURNITURE_TAGS:
                            fs.append(F_["tag_furniture"])
                        elif tag in fu.BODY_TAGS:
                            fs.append(F_["tag_body"])
                        if tag == "noscript":
                            fs.append(F_["in_script"])
                        current = t.add(page, current, EDGE["container"], fs)
                    leaf_tag = tag if tag in ("div", "td") else ""
                else:
                    leaf_tag = tag
                    if tag == "pre":
                        in_pre += 1
                    elif tag == "blockquote":
                        quoted = True
                stack.append((tag, current))
        if "\n" in attributes:
            no += attributes.count("\n")
        if not chunk:
            continue
        if in_title:
            title += html.unescape(chunk)
        elif in_head:
            pass
        elif chunk.isspace():
            if parts:
                parts.append(chunk)
        else:
            was_br = False
            parts.append(chunk)
            if _WORD.search(chunk):
                if "\n" in chunk or "&" in chunk:
                    for at, piece in enumerate(chunk.split("\n"), no):
                        if _WORD.search(html.unescape(piece)) and (not spans or spans[-1] != at):
                            spans.append(at)
                elif not spans or spans[-1] != no:
                    spans.append(no)
                if in_link:
                    linked += len(chunk)
        no += chunk.count("\n")
    flush()
    for c in range(len(t.page) - 1, first - 1, -1):  # from the inner containers outwards
        if c in counts and t.parent[c] >= first:
            k = counts.setdefault(t.parent[c], [0, 0])
            k[0] += counts[c][0]
            k[1] += counts[c][1]
    counts.pop(root, None)
    for c, (words, links) in counts.items():
        share = links / max(1, words)
        t.features[c] += [F_["links_many"] if share > 0.6 else F_["links_some"] if share > 0.2 else F_["links_none"], F_["words_many"] if words >= 60 else F_["words_few"]]
    _positions(t, first)


def add_page(t: Trees, page: int, text: str) -> None:
    """Adds a page in the form its text shows: JSON, HTML, or text."""
    if text[:1] == "\ufeff":  # a byte order mark is no text, but keeps its line
        text = text[1:]
    if not text or text.isspace():
        return
    if text.lstrip()[0] in "{[" and _looks_like_json(text):
        t.data.add(page)
    elif "<" in text and _looks_like_html(text):
        add_html_page(t, page, text)
    else:
        add_text_page(t, page, text)


_TAGS = "html|head|body|div|p|section|article|main|nav|footer|header|aside|ul|ol|li|dl|table|tr|td|th|h[1-6]|span|a|form|title|meta|link|style|script|noscript|blockquote|pre|img|br|hr|iframe"
_BEGINS_WITH_TAG = re.compile(rf"\s*<(?:!doctype\b|!--|\?xml\b|(?:{_TAGS})(?=[\s/>]))", re.I)
_PAIRED = re.compile(rf"</(?:{_TAGS.replace('|meta|link', '').replace('|img|br|hr', '')})\s*>", re.I)


def _looks_like_html(text: str) -> bool:
    """The text begins with a tag, or holds as many closing tags, wherever, as half its lines."""
    return _BEGINS_WITH_TAG.match(text) is not None or len(_PAIRED.findall(text)) >= max(2, 0.5 * (text.count("\n") + 1))


def _looks_like_json(text: str) -> bool:
    s = text.strip()
    return (s[0] == "{" and s[-1] == "}" and re.match(r"\{\s*(?:\"|\})", s) is not None) or (s[0] == "[" and s[-1] == "]" and re.match(r"\[\s*[\"\[{\d\-tfn\]]", s) is not None and "](" not in s)
