"""Tokens of Java texts, one letter each, as flat lines that regular expressions can read.

This is the lexical pass only: it splits texts, pairs brackets, and writes one line per
pair of brackets. What the lines mean (declarations, calls, methods) is asked of them by
column expressions in ``operators/facts.py``. Many texts are read at once, as arrays over
their bytes and tokens. Linear in the text, whatever its nesting.
"""

import re
from collections.abc import Iterator

import numpy as np

#: Bytes of whole texts that are read at once.
_BYTES = 1 << 18
#: Comments and literals; last, what begins one that does not end. Between texts stands the
#: byte FF, which UTF-8 does not have.
_MARKED = re.compile(
    rb"//[^\n\xff]*+|/\*[^*\xff]*+(?:\*(?!/)[^*\xff]*+)*+\*/"
    rb'|"""[^"\\\xff]*+(?:(?:\\[^\xff]|"(?!""))[^"\\\xff]*+)*+"""|"[^"\\\n\xff]*+(?:\\[^\xff][^"\\\n\xff]*+)*+"'
    rb"|'[^'\\\n\xff]*+(?:\\[^\xff][^'\\\n\xff]*+)*+'"
    rb"|[\"']|/\*",
)
#: What a token is, by its first character; see ``_kind``.
_SPACE, _WORD, _NUMBER, _TEXT, _SIGN, _BEGIN = range(6)
_FIRST = re.compile(r"([\s\x00﷐-﷯])|([^\W\d]|\$)|(\d)|([\"'])|(.)", re.S)

# Codes of tokens: a sign of one byte is its own; ROOT is the begin of a text.
WORD, NUMBER, TEXT, SIGNS, COLONS, ROOT = 128, 129, 130, 131, 132, 255
_CODES = np.array([0, WORD, NUMBER, TEXT, SIGNS, ROOT], np.uint8)

# Words of the language, by letter.
_LETTERS = {
    word.encode(): ord(letter)
    for letter, words in {
        "n": "new",
        "r": "return throw else case assert yield",
        "d": "do",
        "c": "if while for switch catch",
        "h": "throws",
        "f": "interface",
        "k": "package import goto extends implements class enum",
        "x": "instanceof try",
        "y": "synchronized",
        "t": "this super",
        "m": "public protected private static final abstract default native strictfp sealed",
    }.items()
    for word in words.split()
}


class Unreadable(ValueError):
    """Text that is no sequence of Java tokens, or whose brackets do not pair."""


def _kind(character: str) -> int:
    return _FIRST.match(character).lastindex - 1


def _table(chars: str, *codes: int, value: int = 1, dtype=np.bool_) -> np.ndarray:
    """``value`` at the codes of signs and at ``codes``."""
    found = np.zeros(256, dtype)
    found[[*map(ord, chars), *codes]] = value
    return found


_KINDS = np.array([_kind(chr(b)) for b in range(128)] + [_SIGN] * 127 + [_BEGIN], np.uint8)
_STEPS = _table("([{", dtype=np.int8) - _table(")]}", dtype=np.int8)
#: Signs of two characters: bits that the first and the second have in common.
_ONE = _table("=!<>", dtype=np.uint8) | _table(":", value=2, dtype=np.uint8) | _table("-", value=4, dtype=np.uint8)
_TWO = _table("=", dtype=np.uint8) | _table(":", value=2, dtype=np.uint8) | _table(">", value=4, dtype=np.uint8)
_NOT_BEFORE, _NOT_BEHIND, _NAMES = _table(")],"), _table("(["), _table("<", WORD)
#: Type arguments hold words, angles, brackets [ ] and a few signs; brackets begin a level.
_BARRED = ~_table("<>([{].,?&@", WORD, ROOT)
_QUIET = _table("([:{", COLONS)
_KEYWORD_SIZES = np.zeros((256, 16), np.bool_)
for _word in (*_LETTERS, b"new", b"interface"):
    _KEYWORD_SIZES[_word[0], len(_word)] = True
_PLAIN_LETTERS = _table("", *range(256), value=ord("o"), dtype=np.uint8)
for _code, _letter in ((WORD, "w"), (NUMBER, "q"), (TEXT, "s"), (ord("."), "."), (ord("@"), "@")):
    _PLAIN_LETTERS[_code] = ord(_letter)


def shape(source: str) -> tuple[str, str]:
    """(the text on one line with plain spacing, its tokens as lines of letters).

    There is a line per pair of brackets and one for the whole file, in the order in which
    they close: a line break, the opening bracket (^ for the file), the tokens directly
    inside, and ! where ) closes, else #. A token is a letter and the numbers
    begin_end_place_line: its bytes in the laid-out text, its byte in the source, its line.

    * w, and the letters of ``_LETTERS``: words; v: a word after a dot, or after a dot and
      type arguments; a: the name of an annotation; s, q: text, and number that begins with a digit.
    * ( ) with the number of arguments and the bytes of the first; [ ] if empty, else I J;
      { } with the byte in the source behind the closing one, and B C where a dot goes on
      behind the body of an anonymous class or an array. What is inside has its own line.
    * < > around type arguments, inside which a token is - and a comma that could also
      part arguments is ~.
    * , ; . = @ as they are (, ; = without numbers); o: any other token.
    """
    ((plain, lines),) = shapes([source.encode()], every_line=True)
    if plain is None:
        raise Unreadable("a literal, a comment or a bracket without end")
    return plain.decode(), lines.decode()


def shapes(sources: list[bytes | None], every_line: bool = False) -> Iterator[tuple[bytes | None, bytes | None]]:
    """``shape`` of many texts, in UTF-8; nulls for a text that is null or unreadable.

    Left out, unless asked for, are lines without = and without ( behind a word: they
    declare, call and define nothing, such as the insides of an expression.
    """
    first, size = 0, 0
    for n, source in enumerate(sources):
        size += len(source or b"")
        if size >= _BYTES or n == len(sources) - 1:
            given = [s for s in sources[first : n + 1] if s is not None]
            found = iter(_shapes(given, every_line) if given else ())
            for s in sources[first : n + 1]:
                yield (None, None) if s is None else next(found)
            first, size = n + 1, 0


def _bytes_kinds(data: bytes, buf: np.ndarray, sources: list[bytes]) -> tuple[np.ndarray, np.ndarray | None]:
    """The kind of the character that each byte is of; whether it is its first, or nothing for plain ASCII."""
    kinds = _KINDS[buf]
    if all(s.isascii() for s in sources):
        return kinds, None
    leads = (buf & 0xC0) != 0x80
    points = np.frombuffer("\n".join(["", *(s.decode() for s in sources), ""]).encode("utf-32-le"), np.uint32)
    wide = np.flatnonzero(points >= 128)
    known, which = np.unique(points[wide], return_inverse=True)
    of_point = np.zeros(len(points), np.uint8)
    of_point[wide] = np.array([_kind(chr(p)) for p in known], np.uint8)[which]
    high = np.flatnonzero((buf >= 128) & (buf != 255))
    kinds[high] = of_point[(np.cumsum(leads) - 1)[high]]
    return kinds, leads


def _within(size: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which bytes are in one of the spans."""
    steps = np.zeros(size + 1, np.int8)
    steps[begins] += 1
    steps[ends] -= 1
    return np.cumsum(steps[:-1], dtype=np.int8).view(np.bool_)


def _last(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For each limit the last of the sorted values that is not beyond it."""
    return values[np.searchsorted(values, limits, "right") - 1]


def _tokens(data: bytes, buf: np.ndarray, kinds: np.ndarray, leads: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes of tokens, the bytes behind them; bytes where a comment or literal has no end.

    Marks comments as space and literals as text in ``kinds``.
    """
    size = len(buf)
    inner = np.zeros(size, np.bool_)  # bytes of a token but its first
    spans = np.array([m.span() for m in _MARKED.finditer(data)], np.int64).reshape(-1, 2)
    begins, ends = spans[:, 0], spans[:, 1]
    slash = buf[begins] == ord("/")
    open_ = (ends - begins == 1) | slash & (ends - begins == 2) & (buf[begins + 1] == ord("*"))
    if len(spans):
        kinds[_within(size, begins[slash], ends[slash])] = _SPACE
        literal = _within(size, begins[~slash], ends[~slash])
        kinds[literal] = _TEXT
        inner |= literal
        inner[begins[~slash]] = False

    # Words and numbers: a word goes on with digits, a number with letters, but not with $.
    run = (kinds == _WORD) | (kinds == _NUMBER)
    inner[1:] |= run[1:] & run[:-1]
    if b"$" in data:
        at = np.flatnonzero((buf == ord("$")) & run)
        heads = _last(np.flatnonzero(run & ~inner), at)
        at, heads = at[kinds[heads] == _NUMBER], heads[kinds[heads] == _NUMBER]
        inner[at[np.unique(heads, return_index=True)[1]]] = False
    # A dot between digits goes on with the number.
    dots = np.flatnonzero((buf == ord(".")) & (kinds == _SIGN))
    if len(dots):
        joins = (kinds[dots + 1] == _NUMBER) & run[dots - 1]
        if joins.any():
            joins[joins] = kinds[_last(np.flatnonzero(run & ~inner), dots[joins] - 1)] == _NUMBER
            inner[dots[joins]] = inner[dots[joins] + 1] = True
            dots = dots[~joins]
    # Three dots, then signs of two characters: where some overlap, the first counts.
    if len(dots) > 2:
        fresh = np.diff(dots, prepend=-2) != 1
        nth = np.arange(len(dots)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        three = dots[:-2][(nth[:-2] % 3 == 0) & (dots[2:] - dots[:-2] == 2)]
        inner[three + 1] = inner[three + 2] = True
    signs = kinds == _SIGN
    pairs = np.flatnonzero(((_ONE[buf[:-1]] & _TWO[buf[1:]]) != 0) & signs[:-1] & signs[1:])
    if len(pairs):
        fresh = np.diff(pairs, prepend=-2) != 1
        nth = np.arange(len(pairs)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        inner[pairs[nth % 2 == 0] + 1] = True

    solid = kinds != _SPACE
    starts = solid & ~inner
    if leads is not None:
        starts &= leads
    behind = solid.copy()
    behind[:-1] &= starts[1:] | ~solid[1:]
    return np.flatnonzero(starts), np.flatnonzero(behind) + 1, begins[open_]


def _angles(code: np.ndarray, before: np.ndarray, heads: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The < and the > that can hold type arguments. ``order``: tokens level by level."""
    at = np.flatnonzero(((code == ord("<")) | (code == ord(">")))[order])
    if not len(at):
        return at, at
    barred = _BARRED[code] | heads | (code == ord("&")) & (before == ord("&"))
    part = np.cumsum(barred[order])[at]
    at = order[at]
    opens = code[at] == ord("<")
    step = np.where(opens, 1, -1)
    # Depth within a part; the least so far, 0 at most, which a > without partner lowers.
    new = np.diff(part, prepend=-1) != 0
    nth = np.cumsum(new) - 1
    depth = np.cumsum(step)
    depth -= (depth - step)[new][nth]
    shift = nth * (len(at) + 1)
    least = np.minimum.accumulate(np.minimum(depth, 0) - shift) + shift
    paired = opens | (least == np.where(new, 0, np.append(0, least[:-1])))
    # In one depth < and > take turns.
    key = (nth * (len(at) + 2) + depth - least + ~opens)[paired]
    by_depth = np.argsort(key, kind="stable")
    at, opens, key = at[paired][by_depth], opens[paired][by_depth], key[by_depth]
    pairs = np.flatnonzero((key[:-1] == key[1:]) & opens[:-1] & ~opens[1:])
    return at[pairs], at[pairs + 1]


def _inside(up: np.ndarray, down: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which tokens, level by level, stand between one of ``up`` and its partner of ``down``."""
    steps = np.zeros(len(order), np.int32)
    steps[up] = 1
    steps[down] = -1
    steps = steps[order]
    return np.cumsum(steps) - (steps > 0) > 0


def _written(prefixes: np.ndarray, values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Each prefix and the number behind it, if not negative; ends of these."""
    width = np.ones(len(values), np.uint8)
    limit, most = 1, int(values.max(initial=0))
    width += values >= 0
    while (limit := limit * 10) <= most:
        width += values >= limit
    ends = np.cumsum(width, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - width] = prefixes
    number = np.flatnonzero(values >= 0)
    rest, at = values[number], ends[number] - 1
    while len(rest):
        left = rest // 10
        out[at] = rest - left * 10 + ord("0")
        more = left > 0
        rest, at = left[more], at[more] - 1
    return out.tobytes(), ends


def _shapes(sources: list[bytes], every_line: bool) -> list[tuple[bytes | None, bytes | None]]:
    data = b"\xff".join([b"", *sources, b""])
    buf = np.frombuffer(data, np.uint8)
    kinds, leads = _bytes_kinds(data, buf, sources)
    starts, behind, faults = _tokens(data, buf, kinds, leads)
    texts = np.flatnonzero(buf == 255)
    bad = np.zeros(len(sources), np.bool_)
    bad[np.searchsorted(texts, faults) - 1] = True

    # Tokens of readable texts, each text behind its ROOT, and one ROOT at the end.
    while True:
        code, size = _CODES[kinds[starts]], behind - starts
        sign = np.flatnonzero(code == SIGNS)
        one = sign[size[sign] == 1]
        code[one] = buf[starts[one]]
        code[sign[(size[sign] == 2) & (buf[starts[sign]] == ord(":"))]] = COLONS
        roots = np.flatnonzero(code == ROOT)
        file = np.repeat(np.arange(len(roots)), np.diff(roots, append=len(code)))
        steps = _STEPS[code]
        depth = np.cumsum(steps, dtype=np.int32)
        unpaired = (depth[roots[1:]] != depth[roots[:-1]]) | (np.minimum.reduceat(depth, roots[:-1]) < depth[roots[:-1]])
        drop = np.append(bad | unpaired, False)
        bad |= unpaired
        kept = (code == ROOT) | ~drop[file]
        if kept.all():
            break
        starts, behind = starts[kept], behind[kept]

    # Brackets and their partners.
    n = len(code) - 1
    brackets = np.flatnonzero(steps)
    outer = depth[brackets] - (steps[brackets] > 0)
    brackets = brackets[_by_depth(outer)]
    opens, closes = brackets[::2], brackets[1::2]
    bad[file[opens[code[closes] - code[opens] != 1 + (code[opens] != ord("("))]]] = True
    partner = np.full(n + 1, -1, np.int32)
    partner[opens], partner[closes] = closes, opens

    before, next_ = np.empty_like(code), np.empty_like(code)
    before[0], before[1:], next_[-1], next_[:-1] = ROOT, code[:-1], ROOT, code[1:]

    # The text as it is laid out: bytes behind each token, in all texts.
    gap = np.zeros(n + 1, np.bool_)
    gap[1:] = starts[1:] > behind[:-1]
    gap &= (code != ROOT) & (before != ROOT) & ~_NOT_BEFORE[code] & ~_NOT_BEHIND[before]
    # No space where the plain spacing has none, nor around the dot of a name.
    gap &= ~((before == ord(".")) & _NAMES[code] | (code == ord(".")) & _NAMES[next_])
    size[roots] = 0
    ends = np.cumsum(size + gap)
    ends -= ends[roots][file]
    begins = ends - size
    laid = buf.copy()
    solid = (kinds != _SPACE) & (kinds != _BEGIN)
    blanks = starts[gap] - 1
    laid[blanks], solid[blanks] = ord(" "), True
    plain = laid[solid].tobytes()
    until = np.append(0, np.cumsum(np.add.reduceat(solid, texts[:-1], dtype=np.int64))).tolist()

    # Tokens level by level; an opening bracket, and ROOT, is the head of its level.
    code, before, next_ = code[:n], before[:n], next_[:n]
    head = (steps[:n] > 0) | (code == ROOT)
    order = _by_depth(depth[:n])
    first = np.flatnonzero(head[order])
    heads = order[first]
    level = np.repeat(np.arange(len(heads)), np.diff(first, append=n))
    level_of = np.empty(n + 1, np.int64)
    level_of[heads] = np.arange(len(heads))
    hidden = quiet = np.zeros(n, np.bool_)
    up, down = _angles(code, before, head, order)
    if len(up):
        partner[up], partner[down] = down, up
        hidden = _inside(up, down, order)
        # Commas between these cannot part arguments.
        sure = (before[up] == ord(".")) | _QUIET[next_[down]]
        quiet = _inside(up[sure], down[sure], order)

    # Lines that are written, by where they close.
    if every_line:
        wanted = np.ones(len(heads), np.bool_)
    else:
        key = code == ord("=")
        rounds = np.flatnonzero(code == ord(")"))
        key[rounds] = before[partner[rounds]] == WORD
        wanted = np.zeros(len(heads), np.bool_)
        wanted[level[key[order]]] = True
    close = np.where(code[heads] == ROOT, roots[1:][file[heads]], partner[heads])
    chosen = np.flatnonzero(wanted[level])
    lines = np.flatnonzero(wanted)
    counts = np.bincount(level[chosen], minlength=len(heads))[lines]
    by_close = np.argsort(close[lines])
    line_begins, counts, lines = (np.cumsum(counts) - counts)[by_close], counts[by_close], lines[by_close]
    line_ends = np.cumsum(counts)
    chosen = chosen[np.repeat(line_begins - (line_ends - counts), counts) + np.arange(len(chosen))]
    tokens, hidden, quiet_ = order[chosen], hidden[chosen], quiet[chosen]

    # Arguments: their number, the bytes of the first.
    c = code[tokens]
    rounds = tokens[(c == ord(")")) & ~hidden]
    arguments = _arguments(level_of[partner[rounds]], level, order, code, head, quiet, partner, begins, ends)

    # Pieces of the lines: prefixes, each with or without a number.
    is_head, is_part = head[tokens], (c == ord(",")) | (c == ord(";"))
    is_close = (steps[tokens] < 0) & ~hidden
    bare = hidden | is_part | (c == ord("="))
    number = np.full(len(tokens), 4, np.uint8)
    number[is_head], number[bare & ~is_head] = 2, 1
    for bracket, k in ((")", 11), ("]", 8), ("}", 9)):
        number[is_close & (c == ord(bracket))] = k
    number[line_ends - 1] += 1
    last = np.cumsum(number, dtype=np.int64)
    at = last - number
    pieces = int(last[-1]) if len(last) else 0
    prefixes, values = np.full(pieces, ord("_"), np.uint8), np.full(pieces, -1, np.int32)

    x, p = tokens[is_head], at[is_head]
    prefixes[p], prefixes[p + 1] = ord("\n"), np.where(code[x] == ROOT, ord("^"), code[x])
    few = bare & ~is_head
    prefixes[at[few]] = np.where(hidden[few], np.where(is_part[few] & ~quiet_[few], ord("~"), ord("-")), c[few])
    prefixes[last[line_ends - 1] - 1] = np.where(c[line_ends - counts] == ord("("), ord("!"), ord("#"))

    newlines = np.cumsum(buf == ord("\n"), dtype=np.int32)

    def numbered(x: np.ndarray, p: np.ndarray) -> None:
        root = roots[file[x]]
        numbers = begins[x], ends[x], starts[x] - starts[root] - 1, newlines[starts[x]] - newlines[starts[root]] + 1
        for k, v in enumerate(numbers):
            values[p + k] = v

    some = ~(is_head | bare | is_close)
    x, p = tokens[some], at[some]
    prefixes[p] = _letters(data, x, code, before, partner, starts, size)
    numbered(x, p)
    for bracket, more in ((")", 3), ("]", 0), ("}", 1)):
        some = is_close & (c == ord(bracket))
        x, p = tokens[some], at[some]
        j = partner[x]
        opened, closed = code[j], code[x]
        if bracket == ")":
            for k, v in enumerate(arguments):
                values[p + 4 + k] = v
        elif bracket == "}":
            values[p + 4] = starts[x] - starts[roots[file[x]]]
            goes_on = (next_[x] == ord(".")) & ((before[j] == ord(")")) | (before[j] == ord("]")))
            opened, closed = np.where(goes_on, ord("B"), opened), np.where(goes_on, ord("C"), closed)
        else:
            full = j < x - 1
            opened, closed = np.where(full, ord("I"), opened), np.where(full, ord("J"), closed)
        prefixes[p], prefixes[p + 4 + more] = opened, closed
        numbered(j, p)
        numbered(x, p + 4 + more)

    letters, written = _written(prefixes, values)
    stops = np.append(0, written[last[line_ends - 1] - 1])
    stops = stops[np.searchsorted(file[heads[lines]], np.arange(len(sources) + 1))].tolist()
    return [
        (None, None) if unread else (plain[until[k] : until[k + 1]], letters[stops[k] : stops[k + 1]])
        for k, unread in enumerate(bad.tolist())
    ]


def _by_depth(depth: np.ndarray) -> np.ndarray:
    """The order by depth, and then by place. (Small integers are sorted in linear time.)"""
    return np.argsort(depth.astype(np.uint16) if depth.max(initial=0) < 1 << 16 else depth, kind="stable")


def _letters(data: bytes, tokens: np.ndarray, code: np.ndarray, before: np.ndarray, partner: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Letters of tokens that have one."""
    c, b = code[tokens], before[tokens]
    out = _PLAIN_LETTERS[c]
    out[(c == NUMBER) & (b == ord("."))] = ord("o")
    matched = ((c == ord("<")) | (c == ord(">"))) & (partner[tokens] >= 0)
    out[matched] = c[matched]
    word = c == WORD
    # Behind a dot, or a dot and type arguments, which the > before ends.
    mate = np.where(b == ord(">"), partner[tokens - 1], -1)
    named = word & ((b == ord(".")) | (mate >= 0) & (before[mate] == ord(".")))
    noted = word & (b == ord("@"))
    n, s = size[tokens], starts[tokens]
    candidates = np.flatnonzero(word & (n < 16) & _KEYWORD_SIZES[np.frombuffer(data, np.uint8)[s], np.minimum(n, 15)])
    out[named], out[noted] = ord("v"), ord("a")
    spans = zip(candidates.tolist(), s[candidates].tolist(), (s + n)[candidates].tolist(), named[candidates].tolist(), noted[candidates].tolist())
    for i, begin, end, after_dot, after_at in spans:
        letter = _LETTERS.get(t := data[begin:end])
        if letter and (t == b"new" or not after_dot and (t == b"interface" or not after_at)):
            out[i] = letter
    return out


def _arguments(
    levels: np.ndarray, level: np.ndarray, order: np.ndarray, code: np.ndarray, head: np.ndarray, quiet: np.ndarray,
    partner: np.ndarray, begins: np.ndarray, ends: np.ndarray,
) -> list[np.ndarray]:
    """Of levels: the number of arguments, and the bytes of the first (0 where there is none)."""
    if not len(levels):
        return [levels] * 3
    needed = np.zeros(level[-1] + 1, np.bool_)
    needed[levels] = True
    # Heads, commas that part arguments, and tokens of arguments.
    at = np.flatnonzero(needed[level])
    parts = (code[order[at]] == ord(",")) | (code[order[at]] == ord(";"))
    at, parts = at[~(parts & quiet[at])], parts[~(parts & quiet[at])]
    tokens = order[at]
    is_head = head[tokens]
    fresh = ~(is_head | parts)
    inside = fresh.copy()
    fresh[1:] &= ~inside[:-1]
    group, heads = np.cumsum(fresh), np.flatnonzero(is_head)
    nth = group - group[heads][np.cumsum(is_head) - 1]
    opener = np.where(code[tokens] == ord(")"), partner[tokens], tokens)
    for bracket in ("]", "}"):
        opener = np.where(code[tokens] == ord(bracket), partner[tokens], opener)
    first = inside & (nth == 1)
    found = (
        nth[np.append(heads[1:], len(nth)) - 1],
        np.maximum.reduceat(np.where(first & fresh, begins[opener], 0), heads),
        np.maximum.reduceat(np.where(first, ends[tokens], 0), heads),
    )
    place = np.empty(len(needed), np.int64)
    place[level[at][heads]] = np.arange(len(heads))
    return [values[place[levels]] for values in found]
