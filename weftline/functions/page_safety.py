"""What a page hides from its readers but shows to machines: passes over a page's tree, in their order (OP-132..140), and what payment walls hide (OP-157).

A pass hides elements or clears attributes of a view and tells how often. ``PASSES`` is the registry; add to it to have more of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from weftline.functions.dom import View, body_of, main_content, to_markdown
from weftline.functions.safety import HIDDEN_SIGNS, INJECTION

LEAST_HIDDEN = 20
# Styles that hide an element.
HIDING_STYLES = (
    r"display\s*:\s*none",
    r"visibility\s*:\s*hidden",
    r"opacity\s*:\s*0(?:\.0+)?(?:\s*;|\s*$)",
    r"font-size\s*:\s*0(?:px|em|rem|%)?\s*(?:;|$)",
    r"(?:^|;)\s*height\s*:\s*0(?:px)?\s*(?:;|$)",
    r"(?:^|;)\s*width\s*:\s*0(?:px)?\s*(?:;|$)",
    r"overflow\s*:\s*hidden[^;]{0,200}(?:height\s*:\s*0|max-height\s*:\s*0)",
    r"position\s*:\s*(?:absolute|fixed).{0,200}?(?:left|top)\s*:\s*-\d{4,}",
    r"text-indent\s*:\s*-\d{4,}",
    r"clip-path\s*:\s*inset\s*\(\s*100\s*%",
    r"color\s*:\s*transparent",
)
HIDING = re.compile("|".join(f"(?:{x})" for x in HIDING_STYLES), re.I)
# Classes that hide, words of instructions in attributes, meta names that every page may have.
HIDING_CLASSES = frozenset("d-none hidden invisible visually-hidden sr-only".split())
INSTRUCTION = re.compile(r"(?:ignore|forget|disregard|override|system|instructions?|prompt|you\s+are|act\s+as|pretend|execute|reveal|output)", re.I)
META_NAMES = frozenset("description keywords author robots viewport generator theme-color color-scheme format-detection".split())
META_PROPERTIES = ("og:", "twitter:", "fb:", "article:", "music:", "video:", "book:", "profile:")
_INJECTION = re.compile(INJECTION, re.I)
_SIGNS = re.compile(f"[{HIDDEN_SIGNS}]")


def hidden_text(v: View) -> int:
    """OP-133: elements whose style hides twenty characters or more; the outermost counts."""
    n = 0
    for x in v.nodes():
        style = x.attrs.get("style", "")
        if style and HIDING.search(style) and len(v.below(x).text()) >= LEAST_HIDDEN:
            v.hidden.add(id(x))
            n += 1
    return n


def comments(v: View) -> int:
    """OP-134: comments that give instructions. Views never show any comment."""
    return sum(len(c.strip()) > 20 and _INJECTION.search(c) is not None for c in v.comments())


def _instructs(name: str, value: str) -> bool:
    if name == "alt":
        return _INJECTION.search(value) is not None or (len(value) > 50 and INSTRUCTION.search(value) is not None)
    least = 50 if name.startswith("data-") else 100 if name in ("aria-label", "title") else None
    return least is not None and len(value) > least and INSTRUCTION.search(value) is not None


def attributes(v: View) -> int:
    """OP-135: attributes that give instructions are cleared."""
    n = 0
    for x in v.nodes():
        for k in [k for k, value in x.attrs.items() if _instructs(k, value)]:
            x.attrs[k] = ""
            n += 1
    return n


def invisible_signs(v: View) -> int:
    """OP-136: zero-width and direction signs out of all texts."""
    n = 0
    for x in (v.top, *v.nodes()):
        for i, c in enumerate(x.children):
            if isinstance(c, str) and (found := len(_SIGNS.findall(c))):
                x.children[i] = _SIGNS.sub("", c)
                n += found
    return n


def frames(v: View) -> int:
    """OP-137: frames that load something or that nobody sees."""
    n = 0
    for x in v.nodes():
        if x.tag == "iframe" and (x.attrs.get("src") or x.attrs.get("width") in ("0", "0px") or x.attrs.get("height") in ("0", "0px") or HIDING.search(x.attrs.get("style", ""))):
            v.hidden.add(id(x))
            n += 1
    return n


def hidden_inputs(v: View) -> int:
    """OP-138: long values of hidden inputs that give instructions are cleared."""
    n = 0
    for x in v.nodes():
        value = x.attrs.get("value", "")
        if x.tag == "input" and x.attrs.get("type") == "hidden" and len(value) > 50 and INSTRUCTION.search(value):
            x.attrs["value"] = ""
            n += 1
    return n


def hidden_by_class(v: View) -> int:
    """OP-139: elements with the hidden attribute, or with a class that hides and a text that instructs, of twenty characters or more."""
    n = 0
    for x in v.nodes():
        by_class = not HIDING_CLASSES.isdisjoint(x.attrs.get("class", "").lower().split())
        if not by_class and "hidden" not in x.attrs:
            continue
        text = v.below(x).text()
        if len(text) >= LEAST_HIDDEN and ("hidden" in x.attrs or _INJECTION.search(text) or INSTRUCTION.search(text)):
            v.hidden.add(id(x))
            n += 1
    return n


def metas(v: View) -> int:
    """OP-140: long contents of unusual meta tags that give instructions are cleared."""
    n = 0
    for x in v.nodes():
        a = x.attrs
        if x.tag != "meta" or a.get("name", "").lower() in META_NAMES or a.get("property", "").lower().startswith(META_PROPERTIES) or "charset" in a or "http-equiv" in a:
            continue
        if len(a.get("content", "")) > 100 and INSTRUCTION.search(a["content"]):
            a["content"] = ""
            n += 1
    return n


#: (name, severity, what is done, the pass), in their order.
PASSES: list[tuple[str, str, str, Callable[[View], int]]] = [
    ("hidden-text", "high", "removed", hidden_text),
    ("comment", "medium", "removed", comments),
    ("attribute", "high", "removed", attributes),
    ("unicode-tricks", "medium", "removed", invisible_signs),
    ("frame", "medium", "removed", frames),
    ("hidden-input", "high", "removed", hidden_inputs),
    ("hidden-class", "high", "removed", hidden_by_class),
    ("meta", "medium", "removed", metas),
]


def sanitise_view(v: View) -> dict[str, int]:
    """Applies all passes; what each found, if anything."""
    found = {name: run(v) for name, _, _, run in PASSES}
    return {name: n for name, n in found.items() if n}


# Overlays of payment walls, classes of what they lock, and styles that hide the rest.
OVERLAYS = (
    "[class*='paywall-overlay']", "[class*='paywall-modal']", "[class*='paywall-prompt']", "[class*='paywall-banner']", "[class*='subscribe-prompt']", "[class*='subscribe-modal']", "[class*='premium-overlay']",
    "[class*='premium-modal']", "[class*='piano-offer']", "[class*='piano-modal']", "[class*='regwall']", "[class*='tp-modal']", "[class*='modal-backdrop']", "[id*='paywall-overlay']", "[id*='paywall-modal']",
)
LOCKED = re.compile(r"paywall|subscriber-only|premium-content|metered-content|piano-offer|regwall|locked-content|gated-content", re.I)
LEAST_WORDS = 200


def recovered(v: View) -> str | None:
    """OP-157: the Markdown of a page's main content once overlays are out and locked classes don't hide it; null under 200 words. The text is all in the page."""
    v.hide(OVERLAYS)
    for x in v.nodes():
        if LOCKED.search(x.attrs.get("class", "")):
            x.attrs["class"] = " ".join(c for c in x.attrs["class"].split() if not LOCKED.search(c))
    text = to_markdown(main_content(v))
    return text if len(text.split()) >= LEAST_WORDS else None


__all__ = ["PASSES", "body_of", "recovered", "sanitise_view"]
