"""Lines of a page and what the mark-up says of them: a small helper of ``html_text``."""

from __future__ import annotations

import html
import re

# Elements and names that the mark-up rules know.
#: Content that is never text of the page.
RAW = frozenset("script style title textarea noscript template iframe svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a line before and after them; others run on inside their line.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select"
    " summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav header footer aside form menu dialog head button select".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Words of a class or id that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice"
    " popup promo promoted related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
CONTENT = frozenset(("article", "main"))

MAIN, OUTSIDE, OPEN = 1, 2, 0
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
    r"""|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+>|[^>]*>)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


def _is_furniture(tag: str, attributes: str) -> bool:
    if tag in FURNITURE:
        return True
    if tag in ("html", "body", "main") or not attributes.strip("/> \t\r\n"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            if value in FURNITURE_ROLES:
                return True
        elif name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true":
            return True
        elif name.lower() in ("class", "id") and FURNITURE_WORDS & set(re.split(r"[^a-z]+", value)):
            return True
    return False


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """The page's text lines in order, each MAIN (inside an article), OUTSIDE (of a part that is
    no article text) or OPEN (the mark-up does not say)."""
    lines: list[tuple[str, int]] = []
    part: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, in furniture, in content

    def end_line():
        if part:
            text = " ".join(html.unescape("".join(part)).split())
            if text:
                _, outside, inside = stack[-1] if stack else ("", False, False)
                lines.append((text, OUTSIDE if outside else MAIN if inside else OPEN))
            part.clear()

    page, at = page or "", 0
    while True:
        token = TOKEN.search(page, at)
        part.append(page[at : token.start() if token else len(page)])
        if not token:
            break
        at = token.end()
        if token[0].startswith("<![CDATA["):
            part.append(html.escape(token[0][9:].removesuffix("]]>")))
        if not token[2]:
            continue
        tag = token[2].lower()
        if tag in BLOCKS:
            end_line()
        if token[1]:
            if tag in (name for name, _, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS and any(name == "p" for name, _, _ in stack):
            # A new block ends an open paragraph, and what was left open inside it.
            place = max(i for i, (name, _, _) in enumerate(stack) if name == "p")
            if not any(name in BLOCKS for name, _, _ in stack[place + 1 :]):
                del stack[place:]
        _, outside, inside = stack[-1] if stack else ("", False, False)
        stack.append((tag, outside or _is_furniture(tag, token[3]), inside or tag in CONTENT))
    end_line()
    return lines


def shared(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Rows of the alignment are bit vectors; long lists are halved, so that memory stays bounded.
    """
    known = set(b)
    places = [i for i, x in enumerate(a) if x in known]
    known = {a[i] for i in places}
    rest = [x for x in b if x in known]
    return [places[i] for i in _aligned([a[i] for i in places], rest)]


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Bit j of row i is 0 where the common length of a[:i] and b grows at b[j]."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for x in a:
        same = row & where.get(x, 0)
        row = ((row + same) | (row - same)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _aligned(a: list[int], b: list[int], most_bits: int = 1 << 28) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > most_bits and len(a) > 1:
        half = len(a) // 2
        ahead = f"{_rows(a[:half], b, False)[0]:0{len(b)}b}"[::-1]
        back = f"{_rows(a[half:][::-1], b[::-1], False)[0]:0{len(b)}b}"
        # The best place to cut b: common lengths of the first halves before it and the last after it.
        here, best, cut = back.count("0"), back.count("0"), 0
        for j in range(len(b)):
            here += (ahead[j] == "0") - (back[j] == "0")
            if here > best:
                best, cut = here, j + 1
        return _aligned(a[:half], b[:cut], most_bits) + [half + i for i in _aligned(a[half:], b[cut:], most_bits)]
    rows, found, i, j = _rows(a, b, True), [], len(a), len(b) - 1
    while i and j >= 0:
        if rows[i] >> j & 1:  # no growth at b[j]
            j -= 1
        elif rows[i - 1] >> j & 1:  # it grows there only with a[i - 1]
            found.append(i - 1)
            i, j = i - 1, j - 1
        else:
            i -= 1
    return found[::-1]
