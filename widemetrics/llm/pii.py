"""Format-preserving pseudonyms for personal data: a keyed Feistel permutation per format."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from widemetrics.llm.common import by_place, fields, free_name

ROUNDS = 10

# The forms of the data looked for, by kind, in order of precedence.
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
    r"|(?i:(?:password|passwd|token|secret|api_key|apikey)\s?[=:]\s?[\"']?)[0-9a-f]{16,}(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\d/-]|\.\d)",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"
    r"|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
# End of fixed values.

_FIND = re.compile("|".join(f"(?P<{kind}>{form})" for kind, form in PATTERNS.items()))
_FIRST_DAY, _LAST_DAY = datetime.date(1000, 1, 1), datetime.date(2999, 12, 31)
_DAYS = (_LAST_DAY - _FIRST_DAY).days + 1


def feistel(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network over the least even
    number of bits that holds size, walked on until the value lies below size again."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            side = left if back else right
            block = f"{tweak}|{size}|{i}|{side}".encode()
            mixed = hashlib.blake2b(block, key=key, digest_size=max(8, (half + 7) // 8)).digest()
            f = int.from_bytes(mixed, "little") & mask
            if back:
                left, right = right ^ f, left
            else:
                left, right = right, left ^ f
        value = left << half | right
        if value < size:
            return value


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(form: str, digits: str) -> str:
    """form with its digits replaced one by one."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def _permuted(digits: str, key: bytes, tweak: str, back: bool) -> str:
    if not digits:
        return digits
    n = len(digits)
    return str(feistel(int(digits), 10**n, key, f"{tweak}{n}", back)).zfill(n)


def _walked(value: str, key: bytes, tweak: str, back: bool, valid) -> str:
    """Digits permuted among those that are valid: a value that is not is permuted again."""
    while True:
        value = _permuted(value, key, tweak, back)
        if valid(value):
            return value


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = _digits(text)
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    body = digits[0] + _permuted(digits[1:-1], key, "card", back)
    return _refill(text, next(body + c for c in "0123456789" if luhn(body + c)))


def _north_american(digits: str) -> bool:
    """Any ten digits after the 1, whether assigned or not, unless a second 1 comes first."""
    return digits[0] != "1"


def _phone(text: str, key: bytes, back: bool) -> str | None:
    digits = _digits(text)
    if text[0] != "+" or digits[0] == "1":
        body = digits[-10:]
        if len(digits) not in (10, 11) or not _north_american(body):
            return None
        return _refill(text, digits[:-10] + _walked(body, key, "phone", back, _north_american))
    if not 8 <= len(digits) <= 15 or digits[0] == "0":
        return None
    kept = 1 if digits[0] == "7" else 2
    return _refill(text, digits[:kept] + _permuted(digits[kept:], key, "phone" + digits[:kept], back))


def _social(digits: str) -> bool:
    area, group, serial = digits[:3], digits[3:5], digits[5:]
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    digits = _digits(text)
    return _refill(text, _walked(digits, key, "ssn", back, _social)) if _social(digits) else None


def _ip(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    value = feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(text: str, key: bytes, back: bool) -> str | None:
    """Dates of one day get one pseudonym, whatever their notation.

    Of two small numbers before the year the first is the day after a point
    and the month after a slash, or the other way round if only that is a date.
    """
    a, b, c = re.split(r"[./-]", text)
    orders = ["ymd"] if "-" in text else ["dmy", "mdy"] if "." in text else ["mdy", "dmy"]
    for order in orders:
        part = dict(zip(order, (a, b, c)))
        try:
            day = datetime.date(int(part["y"]), int(part["m"]), int(part["d"]))
        except ValueError:
            continue
        if not _FIRST_DAY <= day <= _LAST_DAY:
            return None
        ordinal = feistel((day - _FIRST_DAY).days, _DAYS, key, "date", back)
        new = _FIRST_DAY + datetime.timedelta(ordinal)
        out = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        sep = next(x for x in text if not x.isdigit())
        return sep.join(out[x] for x in order)
    return None


def _rest97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _classes(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Each digit and each letter stays one, in its case; together they are permuted."""
    value, size, radix = 0, 1, []
    for c in text:
        if c.isascii() and c.isalnum():
            base = 10 if c.isdigit() else 26
            at = ord(c) - ord("0" if c.isdigit() else "a" if c.islower() else "A")
            value, size = value + at * size, size * base
            radix.append(base)
    value = feistel(value, size, key, tweak, back)
    out = []
    for c in text:
        if c.isascii() and c.isalnum():
            base = 10 if c.isdigit() else 26
            value, at = divmod(value, base)
            out.append(chr(ord("0" if c.isdigit() else "a" if c.islower() else "A") + at))
        else:
            out.append(c)
    return "".join(out)


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _rest97(plain) != 1:
        return None
    body = _classes(plain[4:], key, "iban" + plain[:2], back)
    check = 98 - _rest97(plain[:2] + "00" + body)
    rest = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(rest) for c in text)


def _email(text: str, key: bytes, back: bool) -> str | None:
    local, domain = text.rsplit("@", 1)
    return f"{_classes(local, key, 'email', back)}@{domain}"


def _hex(text: str, key: bytes, back: bool) -> str:
    if not set(text) <= set("0123456789abcdef"):
        return _classes(text, key, "hex", back)
    n = len(text)
    return f"{feistel(int(text, 16), 16**n, key, f'hex{n}', back):0{n}x}"


def _secret(text: str, key: bytes, back: bool) -> str | None:
    if text.startswith("AKIA"):
        return "AKIA" + _classes(text[4:], key, "akia", back)
    at = re.search(r"[0-9a-fA-F]+$", text).start()
    return text[:at] + _hex(text[at:], key, back)


_RULES = {
    "email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn,
    "phone": _phone, "card": _card,
}


def _ends(kind: str, text: str, start: int, end: int) -> Iterator[int]:
    """Where shorter values of the form end that begin at start: on group bounds, longest first."""
    for at in range(end - 1, start, -1):
        if text[at] in " .-" and text[at - 1].isalnum() and _EACH[kind].fullmatch(text, start, at):
            yield at


def _beyond(text: str, start: int, end: int) -> bool:
    """Whether a valid card number that begins after start goes on beyond end."""
    for at in range(start + 1, end):
        x = _EACH["card"].match(text, at)
        if x and x.end() > end:
            if _card(x[0], b"", False):
                return True
            for e in _ends("card", text, at, x.end()):
                if e > end and _CARD_GROUPS.fullmatch(text, at, e) and _card(text[at:e], b"", False):
                    return True
    return False


def _value(
    text: str, m: re.Match, kinds: frozenset[str], key: bytes, back: bool
) -> tuple[str, int, int, str] | None:
    """(kind, start, end, pseudonym) of the valid value that begins where the match does.

    The longest one of a kind goes first. Of shorter ones a card number has to
    have the groups that cards are written in, or none that is valid may begin
    further on and go beyond it: in "12 4012 8888 8888 1881" the 12 is none.
    """
    start = m.start()
    for kind in [m.lastgroup, *(k for k in PATTERNS if k != m.lastgroup)]:
        x = m if kind == m.lastgroup else _EACH[kind].match(text, start)
        if kind not in kinds or not x:
            continue
        if made := _RULES[kind](x[0], key, back):
            return kind, start, x.end(), made
        shorter = [e for e in _ends(kind, text, start, x.end()) if _RULES[kind](text[start:e], key, back)]
        usual = [e for e in shorter if kind != "card" or _CARD_GROUPS.fullmatch(text, start, e)]
        if usual or shorter and not _beyond(text, start, shorter[0]):
            end = (usual or shorter)[0]
            return kind, start, end, _RULES[kind](text[start:end], key, back)
    return None


def _first(
    text: str, at: int, kinds: frozenset[str], key: bytes, back: bool
) -> tuple[str, int, int, str] | None:
    """The first valid value from at on, as by _value()."""
    while m := _FIND.search(text, at):
        if value := _value(text, m, kinds, key, back):
            return value
        # Another may begin further on in it.
        at = m.start() + 1
    return None


def replace_all(
    text: str, key: bytes, kinds: frozenset[str] = frozenset(PATTERNS), back: bool = False
) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with each valid value replaced by its pseudonym, and (kind, start, end) of each
    in the old text. back=True undoes it, as pseudonyms keep form and validity."""
    # Every form has a digit, an at sign, AKIA or a mark after a lead word, so most texts need no search.
    if not _MAYBE.search(text) and "AKIA" not in text:
        return text, []
    out, last, found = [], 0, []
    while value := _first(text, last, kinds, key, back):
        kind, start, end, new = value
        # A pseudonym that would be read with digits beside it is permuted again.
        low = max(last, start - REACH)
        before, after = text[max(0, low - 1) : start], text[end : end + REACH]
        for _ in range(100):
            span = kind, len(before), len(before) + len(new)
            seen = _first(before + new + after, min(low, 1), kinds, key, back)
            if seen and seen[:3] == span:
                break
            new = _RULES[kind](new, key, back)
        out += [text[last:start], new]
        found.append((kind, start, end))
        last = end
    return "".join([*out, text[last:]]), found


#: More characters than any number that check digits or a count can refuse has.
REACH = 64
#: How card numbers are grouped where other numbers may follow.
_CARD_GROUPS = re.compile(
    r"\d+|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,4}|\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}|\d{4}[ -]\d{6}[ -]\d{4,5}"
)
_MAYBE = re.compile(r"[0-9@=:]")
_EACH = {kind: re.compile(form) for kind, form in PATTERNS.items()}

SPANS = "array<struct<kind: string, start: int, end: int>>"


def pseudonymised(
    docs: DataFrame,
    key: bytes,
    text: str = "text",
    kinds: frozenset[str] = frozenset(PATTERNS),
    back: bool = False,
) -> DataFrame:
    """docs with the personal data of the text column replaced by keyed pseudonyms.

    Card numbers (Luhn), bank accounts (remainder 97), social security and
    North American or international telephone numbers, IPv4 addresses, calendar
    dates, mail addresses (their local part) and access keys are looked for.
    What is valid is permuted among the values of its format, with its check
    digits made anew; so equal values get equal pseudonyms in every document,
    different ones different pseudonyms, and back=True restores the input.
    Of a form the longest valid value counts, which may end before a number or
    word that the form would also take. Where a pseudonym and the digits beside
    it would read as another value, which for a card number with digits beside
    it is about one time in ten, it is permuted again, so that it can be
    restored; only there do equal values get different ones.
    What only looks alike, such as a number whose check digit is wrong, stays.
    Telephone numbers and addresses count whether assigned or not; of their
    forms there stay North American numbers whose area code begins with 1,
    international ones with a country code that begins with 0 or fewer than 8
    or more than 15 digits, and addresses with a part above 255 or a leading 0.

    Adds pii_spans, (kind, start, end) in characters of the input text; a
    clashing name gets a _ behind. A null text stays null and has no spans, an
    empty one stays empty. Rows are worked on one by one, whole, where they
    are; there is no shuffle.
    """
    spans = free_name(docs, "pii_spans")
    names = docs.columns
    schema = fields(docs, (spans, SPANS))
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        )
        for batch in batches:
            new, found = [], []
            for t in batch.column(at).to_pylist():
                replaced, where = (None, []) if t is None else replace_all(t, key, kinds, back)
                new.append(replaced)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in where])
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, span_type)], names=[*names, spans]
            )

    return by_place(docs).mapInArrow(run, schema)
