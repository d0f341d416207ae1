"""Elements of HTML pages, with nesting: a scanner with a stack of open elements, once over a page."""

from __future__ import annotations

import re

#: Elements without content, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Comments, scripts and styles as a whole (an unclosed one reaches to the end), or one tag with its attributes.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"""
    r"""|<(?P<close>/?)(?P<name>[a-z][^\s/<>"']*+)(?P<rest>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^<>]*+>""",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)""")


def _attributes(rest: str) -> dict[str, str]:
    """Class and id among the attributes; of a repeated one the first counts."""
    found: dict[str, str] = {}
    if "=" in rest:
        for name, value in _ATTRIBUTE.findall(rest):
            found.setdefault(name.lower(), value[1:-1] if value[:1] in "\"'" else value)
    return found


def elements(html: str, selectors: tuple[str, ...], between: str = " ") -> dict[str, str]:
    """The text of the first element that fits each selector: a tag's name, ``.class`` or ``#id``.

    Each tag and comment becomes ``between``; scripts and styles go with their content. An end tag
    closes its nearest open element and all that was opened in it; one without is ignored; what is never
    closed reaches to the end of the element around it. Selectors that nothing fits are left out.
    """
    wanted = set(selectors)
    by_attribute = any(s.startswith((".", "#")) for s in selectors)
    out: list[str] = []
    size = at = 0
    stack: list[tuple[str, list[str]]] = []  # open elements with the selectors that they are the first to fit
    spans: dict[str, list[int]] = {}

    def say(text: str) -> None:
        nonlocal size
        out.append(text)
        size += len(text)

    def shut(depth: int, end: int) -> None:
        while len(stack) > depth:
            for s in stack.pop()[1]:
                spans[s][1] = end

    for token in _TOKEN.finditer(html):
        say(html[at : token.start()])
        at = token.end()
        if token["raw"]:
            continue
        begin = size
        say(between)
        if not token["name"]:
            continue
        name = token["name"].lower()
        if token["close"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                shut(depth, begin)
            continue
        fits = [name] if name in wanted else []
        if by_attribute:
            own = _attributes(token["rest"])
            fits += [f".{c}" for c in own.get("class", "").split() if f".{c}" in wanted]
            if f"#{own.get('id')}" in wanted:
                fits.append(f"#{own['id']}")
        new = [s for s in dict.fromkeys(fits) if s not in spans]
        for s in new:
            spans[s] = [size, size]
        if name not in VOID and not token["rest"].endswith("/"):
            stack.append((name, new))
    say(html[at:])
    shut(0, size)
    text = "".join(out)
    return {s: text[a:b] for s, (a, b) in spans.items()} | ({"": text} if "" in wanted else {})
