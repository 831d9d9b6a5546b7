"""Format-preserving pseudonyms for personal values in texts.

A value that is recognised and passes its check - a date of the calendar, a card number by its check
digit, an account number by its remainder, an address by its ranges - is numbered within all values of
its format, the number is permuted by a keyed Feistel network, and the result is written in the same
format, valid again. The same value has the same pseudonym in every document, two values never share
one, and who holds the key can reverse it (`reverse=True`).

Kinds: email (the name before the @), secret (access key ids, quoted hex digests, values after password=
and the like), iban, card, ssn, date, ip, phone. Each text is handled alone, so nothing is shuffled.

Defined cases: a null text stays null and an empty one empty; values that fail their check stay as they
are; repeated rows are handled each for itself; an empty table gives no rows; other columns are kept by
`pseudonymise`, whatever their names, except those it adds; texts may have any length.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "secret", "iban", "card", "ssn", "date", "ip", "phone")
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

# What a value looks like; the functions below decide.
VALUE = re.compile(
    r"""(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}))
    |(?P<secret>(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])
        |(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32})(?![A-Za-z0-9])
        |(?:(?<=password=)|(?<=api_key=)|(?<=secret=)|(?<=token=))[A-Za-z0-9]{6,128})
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\ [A-Z0-9]{4}){2,7}(?:\ [A-Z0-9]{1,3})?)(?![A-Za-z0-9]))
    |(?P<card>(?<![\w.-])[0-9](?:[\ -]?[0-9]){12,18}(?![\w-]))
    |(?P<ssn>(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?!(?!T[0-9])[\w/-]))
    |(?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9]))
    |(?P<phone>(?<![\w.])(?:\+[0-9]{1,3}[\ .-]?)?(?:\([0-9]{2,4}\)[\ .-]?|[0-9]{2,4}[\ .-])[0-9]{3,4}[\ .-]?[0-9]{3,4}(?![\w-]))
    """,
    re.VERBOSE,
)
_CARD = re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")
#: Lengths of card numbers, usual ones first.
CARD_LENGTHS = (16, 15, 14, 13, 19, 18, 17)
#: Groups that card numbers are usually written in.
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}
_MAY_HOLD = re.compile(r"[0-9@]|password=|api_key=|secret=|token=")


class Feistel:
    """A keyed permutation of 0 ... size - 1 for any size, a different one for every label."""

    def __init__(self, key: bytes, reverse: bool = False):
        self._key = hashlib.blake2b(key, digest_size=32).digest()
        self._reverse = reverse

    def _mask(self, label: str, turn: int, half: int, bits: int) -> int:
        data = half.to_bytes((bits + 7) // 8, "big")
        out, block = b"", 0
        while 8 * len(out) < bits:
            person = f"{turn}.{block}".encode()
            out += hashlib.blake2b(label.encode() + b"\0" + data, key=self._key, person=person).digest()
            block += 1
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def __call__(self, label: str, value: int, size: int) -> int:
        label = f"{label}/{size}"
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:  # steps out of the range are walked on until one falls into it
            left, right = value >> bits, value & ((1 << bits) - 1)
            for turn in reversed(range(ROUNDS)) if self._reverse else range(ROUNDS):
                if self._reverse:
                    left, right = right ^ self._mask(label, turn, left, bits), left
                else:
                    left, right = right, left ^ self._mask(label, turn, right, bits)
            value = left << bits | right
            if value < size:
                return value


def _characters(text: str, permute: Feistel, label: str, hexadecimal: bool = False) -> str:
    """Digits, small and capital letters permuted together, each staying of its class; the rest stays."""
    small = re.search("[A-F]", text) is None

    def alphabet(c: str) -> str:
        if hexadecimal and small and c in "0123456789abcdef":
            return "0123456789abcdef"
        if c in "0123456789":
            return "0123456789"
        if hexadecimal:
            return "abcdef" if c >= "a" else "ABCDEF"
        if "a" <= c <= "z":
            return "abcdefghijklmnopqrstuvwxyz"
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else c

    sets = [alphabet(c) for c in text]
    value, size = 0, 1
    for c, s in zip(text, sets, strict=True):
        value, size = value * len(s) + s.index(c), size * len(s)
    form = "".join("h" if len(s) == 16 else s[0] for s in sets)
    value = permute(f"{label}/{form}", value, size) if size > 1 else value
    out = []
    for s in reversed(sets):
        value, place = divmod(value, len(s))
        out.append(s[place])
    return "".join(reversed(out))


def _written(digits: str, like: str) -> str:
    """`digits` in the places of the letters and digits of `like`."""
    rest = iter(digits)
    return "".join(next(rest) if c.isalnum() else c for c in like)


def _luhn(digits: str) -> int:
    """Check digit that belongs behind `digits`."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _email(text: str, permute: Feistel) -> str | None:
    return _characters(text, permute, "email")


def _secret(text: str, permute: Feistel) -> str | None:
    if text.startswith("AKIA"):
        return "AKIA" + _characters(text[4:], permute, "key")
    digest = re.fullmatch("[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64}|[0-9a-f]+", text)
    return _characters(text, permute, "secret", hexadecimal=digest is not None)


def _remainder(country: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _iban(text: str, permute: Feistel) -> str | None:
    plain = text.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if 98 - _remainder(country, rest) != int(check):
        return None
    rest = _characters(rest, permute, "iban" + country)
    return _written(f"{country}{98 - _remainder(country, rest):02d}{rest}", text)


def _card_place(text: str) -> tuple[int, int] | None:
    """Where a valid card number of whole groups stands.

    Numbers written in one group or in the usual groups come before other readings, then usual lengths, then
    the first: what stands beside a card does not make it part of a longer number.
    """
    groups = [x.span() for x in re.finditer("[0-9]+", text)]
    readings = []
    for i, (a, _) in enumerate(groups):
        sizes: tuple[int, ...] = ()
        for start, b in groups[i:]:
            sizes += (b - start,)
            if (n := sum(sizes)) in CARD_LENGTHS:
                is_usual = len(sizes) == 1 or sizes in CARD_GROUPS
                readings.append((not is_usual, CARD_LENGTHS.index(n), a, b))
    for _, _, a, b in sorted(readings):
        digits = re.sub(r"\D", "", text[a:b])
        if digits[0] != "0" and _luhn(digits[:-1]) == int(digits[-1]):
            return a, b
    return None


def _card(text: str, permute: Feistel) -> tuple[str, int] | None:
    """The text up to the end of a card number in it, changed, and where that end is."""
    if (place := _card_place(text)) is None:
        return None
    a, b = place
    digits = re.sub(r"\D", "", text[a:b])
    inner = digits[1:-1]
    body = digits[0] + f"{permute('card' + digits[0], int(inner), 10 ** len(inner)):0{len(inner)}d}"
    return text[:a] + _written(body + str(_luhn(body)), text[a:b]), b


def _ssn(text: str, permute: Feistel) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    value = permute("ssn", (place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    value, serial = divmod(value, 9999)
    place, group = divmod(value, 99)
    return f"{place + 1 + (place >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _date(text: str, permute: Feistel) -> str | None:
    mark = next(c for c in text if not c.isdigit())
    a, b, c = (int(x) for x in text.split(mark))
    # Year first; else day first, and month first where only that is a date.
    for order in ((2, 1, 0),) if mark == "-" else ((0, 1, 2), (1, 0, 2))[: 1 + (mark == "/")]:
        day, month, year = ((a, b, c)[i] for i in order)
        try:
            number = datetime.date(year, month, day).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= number <= LAST_DAY:
            return None
        new, span = number, LAST_DAY - FIRST_DAY + 1
        form = f"date{mark}{order}{[len(x) for x in text.split(mark)]}"
        while True:  # until the date has the same form: as many digits, and the same reading
            new = FIRST_DAY + permute(form, new - FIRST_DAY, span)
            d = datetime.date.fromordinal(new)
            parts = [0, 0, 0]
            for i, x in zip(order, (d.day, d.month, d.year), strict=True):
                parts[i] = x
            widths = [len(x) for x in text.split(mark)]
            fits = all(
                len(str(x)) <= w
                for x, w in zip(parts, widths, strict=True)
            )
            if fits and not (order[0] == 1 and parts[1] <= 12):
                return mark.join(f"{x:0{w}d}" for x, w in zip(parts, widths, strict=True))
    return None


def _ip(text: str, permute: Feistel) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    value = permute("ip", int.from_bytes(bytes(int(x) for x in parts), "big"), 1 << 32)
    return ".".join(str(x) for x in value.to_bytes(4, "big"))


def _phone(text: str, permute: Feistel) -> str | None:
    country = re.match(r"\+[0-9]{1,3}[ .-]", text) or re.match(r"\+[0-9]{1,3}(?=\()", text)
    head = country.group() if country else ""
    number = text[len(head) :]
    digits = re.sub(r"\D", "", number)
    if not 8 <= len(digits) <= 15:
        return None
    # A first digit other than 0 stays other than 0.
    low = 10 ** (len(digits) - 1) if digits[0] != "0" else 0
    size = 10 ** len(digits) - low if low else 10 ** (len(digits) - 1)
    value = low + permute(f"phone{head}{len(digits)}{low > 0}", int(digits) - low, size)
    return head + _written(f"{value:0{len(digits)}d}", number)


_CHANGE: dict[str, Callable[[str, Feistel], str | tuple[str, int] | None]] = {
    "email": _email,
    "secret": _secret,
    "iban": _iban,
    "card": _card,
    "ssn": _ssn,
    "date": _date,
    "ip": _ip,
    "phone": _phone,
}


def change(text: str, permute: Feistel, counts: dict[str, int]) -> str:
    """The text with its values replaced; counts them by kind."""
    if not _MAY_HOLD.search(text):
        return text

    out, at, found = [], 0, VALUE.search(text)
    while found:
        kind, end = found.lastgroup or "card", found.end()
        new = _CHANGE[kind](found.group(), permute)
        if new is None and kind == "card":
            # Another card number may begin behind the first group and reach further.
            group = re.compile("[0-9]+").match(text, found.start()).end()
            if group < end and (further := _CARD.match(text, group + 1)):
                found = further
                continue
        if new is not None:
            if kind == "card":
                new, length = new
                end = found.start() + length
            out += text[at : found.start()], new
            at = end
            counts[kind] += 1
        found = VALUE.search(text, end)
    return "".join(out) + text[at:]


def pseudonymise(
    docs: DataFrame, key: bytes, reverse: bool = False, text_column: str = "text"
) -> DataFrame:
    """All columns of `docs` with the text changed, and a map _n_values of counts by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute = Feistel(key, reverse)
        for batch in batches:
            texts, numbers = [], []
            for text in batch.column(1):
                counts = dict.fromkeys(KINDS, 0)
                value = text.as_py()
                texts.append(value if value is None else change(value, permute, counts))
                numbers.append(list(counts.items()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(texts, pa.string()),
                    pa.array(numbers, pa.map_(pa.string(), pa.int64())),
                ],
                ["doc", "text", "counts"],
            )

    whole = docs.select(F.struct("*").alias("doc"), F.col(text_column).cast("string").alias("text"))
    # The text travels once: beside the other columns, not in them.
    rest = whole.withColumn("doc", F.col("doc").withField(text_column, F.lit(None).cast("string")))
    kind = rest.schema["doc"].dataType.simpleString()
    return rest.mapInArrow(run, f"doc {kind}, text string, counts map<string,bigint>").select(
        *(F.col("text").alias(c) if c == text_column else F.col("doc")[c].alias(c) for c in docs.columns),
        F.col("counts").alias("_n_values"),
    )
