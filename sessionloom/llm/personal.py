"""Personal information inside free text (problem 2).

E-mail addresses, telephone numbers, identity numbers, postal addresses and people's names are found by their form
and replaced by typed placeholders. Numbers are put through a keyed Feistel network over their own digits and letters:
the placeholder shows another number of the same format (separators kept, check digits, a birth date, sex and month
inside valid again if they were), the same for the same number wherever and however it is written. Other kinds get a
keyed tag of 96 bits of the value in lower case with single blanks. Everything is decided inside one string, so rows spread freely.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import math
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.runtime import table

KINDS = ("email", "id_number", "phone", "address", "person_name")

_W = r"[\s ]{1,3}"  # a blank that may be a line break
_S = r"[\s ]{0,2}"
_SEP = rf"(?:{_W}|[.\-‐‑/])"

# ---- e-mail addresses
_AT = rf"(?:@|＠|{_S}[\[({{]at[\])}}]{_S})"
_DOT = rf"(?:\.|{_S}[\[({{]dot[\])}}]{_S})"
_END = r"(?![A-Za-zÀ-ÿ0-9_])"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+'’-]*[A-Za-z0-9_])?"
_EMAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+'@-])(?:(?P<plain>{_LOCAL}(?:{_S}[\[({{]dot[\])}}]{_S}[A-Za-z0-9_+'-]+)*{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}})(?![A-Za-z0-9@]|-[A-Za-z0-9]|:[A-Za-z0-9~/_.-]*[A-Za-z])"
    rf"|(?P<words>[A-Za-z0-9_+'-]+(?:(?:\.|{_W}dot{_W})[A-Za-z0-9_+'-]+)*{_W}at{_W}{_LABEL}(?:{_W}dot{_W}{_LABEL})+)(?![A-Za-z0-9]))",
    re.I,
)

# ---- identity numbers; each stands behind its label
_IS = rf"(?:{_S}(?:is|no\.?|nr\.?|number|numéro|n°|号码|号|为|是)(?![A-Za-z]))?{_S}[:：=#]?{_S}"
_ID = re.compile(
    rf"(?<![A-Za-z])(?:(?:SSN|social{_W}security){_IS}(?P<ssn>\d{{3}}[-\s]?\d{{2}}[-\s]?\d{{4}})"
    rf"|(?:NIR|s[ée]cu(?:rit[ée]{_W}sociale)?|INSEE){_IS}(?P<nir>\d(?:{_S}\d\d){{3}}(?:{_S}\d{{3}}){{2}}{_S}\d\d)"
    rf"|(?:steuer(?:liche{_W})?-?(?:ID(?:entifikationsnummer)?|IdNr\.?)|IdNr\.?|Identifikationsnummer){_IS}(?P<tax>\d\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}})"
    rf"|passport{_IS}(?P<passport>[A-Z]{{1,2}}\d{{6,9}})"
    rf"|(?:driving{_W}licen[cs]e|licen[cs]e){_IS}(?P<licence>[A-Z]{{2}}-\d{{3}}-\d{{3}}-\d{{2}})"
    rf"|(?:NINO|national{_W}insurance|NI(?={_W}(?:no|number|nr)\b)){_IS}(?P<nino>[A-Z]{{2}}{_S}\d\d{_S}\d\d{_S}\d\d{_S}[A-D]))(?![A-Za-z0-9]|-\d)"
    rf"|(?:身份证|居民身份证){_IS}(?P<resident>\d{{17}}[\dX])(?![A-Za-z0-9])",
    re.I,
)

# ---- telephone numbers by national form
_PHONE = re.compile(
    r"(?<![A-Za-z0-9_.+@/\-])(?:"
    rf"(?:\+1|001){_SEP}?\(?\d{{3}}\)?{_SEP}?\d{{3}}{_SEP}?\d{{4}}"
    rf"|(?:\+44|0044){_SEP}?(?:\(0\){_S})?(?:20{_SEP}?\d{{4}}{_SEP}?\d{{4}}|\d{{4}}{_SEP}?\d{{3}}{_SEP}?\d{{3}})"
    rf"|(?:\+33|0033){_SEP}?(?:\(0\){_S})?[1-9](?:{_SEP}?\d\d){{4}}"
    rf"|(?:\+49|0049){_SEP}?(?:\(0\){_S})?\d{{2,4}}{_SEP}?(?:\d{{5}}{_SEP}\d{{3}}|\d{{6,8}})"
    rf"|(?:\+86|0086){_SEP}?1\d\d{_SEP}?\d{{4}}{_SEP}?\d{{4}}"
    rf"|\(0\)?\d{{2,4}}\){_S}(?:\d{{5}}{_SEP}\d{{3}}|\d{{4}}{_SEP}?\d{{4}}|\d{{6,8}})"
    rf"|\(\d{{3}}\){_SEP}?\d{{3}}{_SEP}\d{{4}}"
    r"|\d{3}([-.])\d{3}\1\d{4}"
    rf"|020{_SEP}\d{{4}}{_SEP}\d{{4}}|01\d{{3}}{_SEP}\d{{6}}|01\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{3}}"
    rf"|0[1-9](?:(?:{_W}|[.-])\d\d){{4}}"
    r"|0\d{2,4}/\d{5,8}(?:-\d{1,4})?"
    r")(?![A-Za-z0-9_]|[-./:]\d)"
)

# ---- postal addresses
# Words that English street names and second words of English town names end in.
_ROAD = r"(?:lane|road|street|blvd|boulevard|avenue|ave|close|drive|court|crescent|terrace|square|place|way|row|walk|gardens|grove|hill|rd|st|dr|ln|ct)"
_PLACE = r"(?:fen|cross|green|hill|bridge|park|city|town|heath|moor|wood|ford|bay|vale|common|end|beach|falls|springs|heights|grove|valley|mills|port|harbour|harbor|point|lake|creek|village|spa|abbey|market|wells)"
_JOIN = rf"(?:{_S},{_W}|{_W})"
_CAP = r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]+"
_TOWN = rf"(?:{_CAP}(?:{_W}{_CAP}){{0,2}}{_W}\d{{5}}(?!\d)|(?:North|South|East|West|Saint|St\.|New|Great|Little|Upper|Lower|Port|Fort|Mount){_W}{_CAP}|{_CAP}{_W}(?:(?i:{_PLACE}))\b|{_CAP})"
_town = rf"(?:[a-z]+(?:{_W}[a-z]+){{0,2}}{_W}\d{{5}}(?!\d)|[a-z]+{_W}{_PLACE}\b|[a-z]+)"
_CODE = rf"(?:{_S},?{_W}\d{{5}}(?!\d))?"
_HAN = "一-鿿"
_FLAT = rf"(?:(?i:Flat|Apt\.?|Apartment|Unit|Suite){_W}\d+[A-Za-z]?)"
#: Forms of addresses, each tried only where one of its words occurs in the text in lower case.
_ADDRESSES = [
    (("box",), re.compile(rf"(?<![A-Za-z0-9_])(?i:P\.?{_S}O\.?{_W}Box){_W}\d+(?:{_JOIN}{_TOWN}{_CODE})?")),
    (
        (" lane", " road", " street", " blvd", " boulevard", " ave", " close", " drive", " court", " crescent", " terrace", " square", " place", " way", " row", " walk", " gardens", " grove", " hill", " rd", " st", " dr", " ln", " ct"),
        re.compile(
            rf"(?<![A-Za-z0-9_.])(?:{_FLAT}{_JOIN})?\d{{1,5}}[A-Za-z]?,?{_W}(?:{_CAP}{_W}){{1,3}}(?i:{_ROAD})\b\.?(?:{_JOIN}{_FLAT})?(?:{_JOIN}{_TOWN}{_CODE})?"
            rf"|(?<![A-Za-z0-9_.])(?:flat{_W}\d+[a-z]?{_JOIN})?\d{{1,5}}[a-z]?,?{_W}(?:[a-z]+{_W}){{1,3}}{_ROAD}\b\.?(?:{_JOIN}apt{_W}\d+)?{_S},{_W}{_town}{_CODE}"
        ),
    ),
    (
        ("rue ", "avenue ", "quai ", "impasse ", "chemin ", "place ", "boulevard ", "bd ", "allée ", "allee ", "cours ", "route ", "square ", "passage "),
        re.compile(rf"(?<![A-Za-z0-9_.])\d{{1,4}}(?:{_W}(?:bis|ter|quater))?,?{_W}(?i:rue|avenue|quai|impasse|chemin|place|boulevard|bd|all[ée]e|cours|route|square|passage){_W}(?:[\w'’-]+{_W}){{0,4}}?[\w'’-]+{_JOIN}\d{{5}}{_W}{_CAP}(?:{_W}(?:sur|sous|en|les?|la){_W}{_CAP})?"),
    ),
    (
        ("str.", "straße", "strasse", "weg ", "gasse ", "allee ", "platz ", "ring ", "damm ", "ufer "),
        re.compile(rf"(?<![A-Za-zÀ-ÿ0-9_-])[A-ZÄÖÜ][A-Za-zÀ-ÿ-]*(?:(?<=\w)(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz|ring|damm|ufer)|(?<=-)(?:Stra(?:ß|ss)e|Str\.|Weg|Gasse|Allee|Platz|Ring|Damm|Ufer)){_W}\d{{1,4}}(?:{_S}[a-zA-Z]\b)?{_JOIN}\d{{5}}{_W}{_CAP}(?:{_W}(?:am|an|im|bei|ob){_W}(?:der{_W})?{_CAP})?"),
    ),
    (("号",), re.compile(rf"(?:[{_HAN}]{{2,3}}省)?(?:(?<![{_HAN}])[^\W\d_A-Za-z寄到送至在住往址为是于]{{2,4}}|(?![寄到送至在住往址为是于])[{_HAN}][{_HAN}])市(?:[{_HAN}]{{1,4}}[区县])?[{_HAN}]{{1,6}}[路街道巷]{_S}\d+{_S}号(?:{_S}\d+{_S}[室栋单元楼号]+)*")),
]
_NUMBERS = re.compile(r"[+(\d][\d() ./\s ‐‑-]{7,}\d")
#: Stretches of characters that an e-mail address in any of its spellings may have, and signs that one may be there.
_MAIL_RUN = re.compile(r"[A-Za-z0-9._%+'’@＠\[\](){}\s-]+")
_AT_SIGNS = re.compile(r"[@＠]|[\[({]at[\])}]|\bat\b.*?\sdot\b", re.I | re.S)
_MAIL_TAIL = re.compile(r"(?::[A-Za-z0-9~/_.-]*)?.?", re.S)
_ID_WORDS = ("ssn", "security", "nir", "secu", "sécu", "insee", "idnr", "steuer", "identifikation", "passport", "licen", "nino", "insurance", "ni n", "身份证")


def learn_names(known: list[tuple[str, str]]) -> dict[str, tuple[list[str], list[str]]]:
    """Stems and endings of given names and surnames, from (kind, name).

    A name is cut where stem and ending are both found with the most other names, the stem at least once more. An
    ending counts if two names are cut so; a name whose stem is its own is cut before the longest such ending.
    """
    out = {}
    for kind in ("given", "surname"):
        whole = sorted({n.strip() for k, n in known if k == kind and n and n.strip()})
        names = [n for n in whole if len(n) >= 5]  # shorter ones are not cut
        stems, ends = defaultdict(set), defaultdict(set)
        for n in names:
            for i in range(3, len(n) - 1):
                stems[n[:i]].add(n[i:])
                ends[n[i:]].add(n[:i])
        cut = {}
        for n in names:
            score = {i: math.log(len(stems[n[:i]])) + math.log(len(ends[n[i:]])) for i in range(3, len(n) - 1) if len(stems[n[:i]]) > 1}
            cut |= {n: [i for i, x in score.items() if x > max(score.values()) - 1e-9]} if score else {}
        count = defaultdict(int)
        for n, places in cut.items():
            for i in places:
                count[n[i:]] += 1
        kept = sorted((e for e, c in count.items() if c > 1), key=len, reverse=True)
        rest = {n: next((n[: -len(e)] for e in kept if n.endswith(e) and len(n) - len(e) > 2), n) for n in names if n not in cut}
        out[kind] = (sorted({n[:i] for n, places in cut.items() for i in places} | set(rest.values())), sorted(kept))
        out[kind + "_whole"] = (whole, [])
    return out


class Names:
    """A name pattern behind a quick look at the single words, of which one must be a surname or part of one."""

    def __init__(self, pattern: re.Pattern, surname: re.Pattern, least: int):
        self.pattern, self.surname, self.seen = pattern, surname, {}
        self.words = re.compile(rf"[^\W\d_]{{{least},}}")

    def finditer(self, text: str):
        for w in self.words.findall(text):
            known = self.seen.get(w)
            if known is None:
                if len(self.seen) > 1 << 18:
                    self.seen.clear()
                known = self.seen[w] = self.surname.search(w) is not None
            if known:
                return self.pattern.finditer(text)
        return ()


def name_pattern(known: list[tuple[str, str]]) -> Names | None:
    """People's names: a given name or initial with a surname, in either order.

    A word counts if it is a known name, or any learned stem with any learned ending of its kind (in any case), or if
    it is capitalised, has a learned ending, and its partner is a name by its ending too.
    """
    g = learn_names(known)
    if not all(g[k][0] for k in ("given", "surname")):
        return None
    any_of = lambda xs: "|".join(sorted(map(re.escape, xs), key=len, reverse=True)) or "(?!)"

    def word(kind: str) -> str:
        return rf"(?i:(?:{any_of(g[kind][0])})(?:{any_of(g[kind][1])})|{any_of(g[kind + '_whole'][0])})"

    def shape(kind: str) -> str:
        ends = [e for e in g[kind][1] if len(e) >= 3]
        return rf"(?:[A-Z][a-z]{{2,5}}(?:{any_of(ends)})|[A-Z]{{3,6}}(?:{any_of([e.upper() for e in ends])}))"

    giv, sur = rf"(?:{word('given')}|{shape('given')}){_END}", rf"(?:{word('surname')}|{shape('surname')})"
    sur = rf"{sur}(?:-{sur})?{_END}"
    strict = rf"{word('surname')}(?:-{word('surname')})?{_END}"
    initial = rf"(?:[A-Z]\.{_S}){{1,2}}"
    whole = re.compile(rf"(?<![A-Za-z0-9_.@/'’+-])(?:{giv}{_W}(?:{initial})?{sur}|{initial}(?:{strict}|{shape('surname')}{_END})|{strict},{_W}{giv}(?:{_W}[A-Z]\.(?![A-Za-z]))?)(?![A-Za-z0-9_@/+]|-[A-Za-z]|\.[A-Za-z0-9])")
    # Of a known surname with other characters than letters its longest run of letters is looked for.
    runs = [max(re.findall(r"[^\W\d_]+", n) or [""], key=len) for n in g["surname_whole"][0]]
    parts = "|".join(sorted({re.escape(r) for r, n in zip(runs, g["surname_whole"][0], strict=True) if r != n}))
    made = [len(a) + len(b) for a in g["surname"][0] for b in g["surname"][1]]
    return Names(whole, re.compile(f"{sur}|(?i:{parts})" if parts else sur), max(1, min([6, *made, *map(len, runs)])))


def find(text: str, names: Names | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal values in a text, in order, without overlaps."""
    hits: list[tuple[int, int, str]] = []

    def take(a: int, b: int, kind: str) -> None:
        if b > a and all(b <= x or a >= y for x, y, _ in hits):
            hits.append((a, b, kind))

    low = text.lower()
    if "@" in low or "＠" in low or "dot" in low or "at)" in low or "at]" in low or "at}" in low:
        for run in _MAIL_RUN.finditer(text):
            if _AT_SIGNS.search(text, run.start(), run.end()):
                for m in _EMAIL.finditer(text, run.start(), _MAIL_TAIL.match(text, run.end()).end()):
                    take(*m.span(), "email")
    if any(w in low for w in _ID_WORDS):
        for m in _ID.finditer(text):
            take(*m.span(m.lastgroup), "id_number")
    for run in _NUMBERS.finditer(text):
        for m in _PHONE.finditer(text, run.start(), min(len(text), run.end() + 3)):
            take(*m.span(), "phone")
    places = [m.span() for words, form in _ADDRESSES if any(w in low for w in words) for m in form.finditer(text)]
    for a, b in sorted(places, key=lambda x: (x[0], -x[1])):  # of two forms that overlap, the one that begins first
        while text[b - 1] in " .,;\n\t":
            b -= 1
        take(a, b, "address")
    if names is not None:
        for m in names.finditer(text):
            take(*m.span(), "person_name")
    return sorted(hits)


def _clean(value: str) -> str:
    return re.sub(r"[\s ]+", " ", value).strip()


# ---- pseudonyms
def _round(key: bytes, step: int, tag: str, value: int, most: int) -> int:
    h = hashlib.blake2b(f"{step}:{tag}:{value}".encode(), key=key, digest_size=16).digest()
    return int.from_bytes(h, "big") % most


def feistel(value: int, size: int, key: bytes, tag: str) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network on two near-equal halves, walked until it is in range."""
    if size < 2:
        return value
    a = max(2, math.isqrt(size - 1) + 1)
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for step in range(0, 8, 2):
            left = (left + _round(key, step, tag, right, a)) % a
            right = (right + _round(key, step + 1, tag, left, b)) % b
        value = left * b + right
        if value < size:
            return value


_DAYS, _FIRST = 73_049, datetime.date(1900, 1, 1)  # to the end of 2099


def permute_digits(digits: str, key: bytes, tag: str) -> str:
    return f"{feistel(int(digits), 10 ** len(digits), key, f'{tag}{len(digits)}'):0{len(digits)}d}" if digits else ""


def _resident(s: str, key: bytes) -> str:
    """A resident number: region, birth date, serial and check character, the date staying a date."""
    try:
        day = (datetime.date(int(s[6:10]), int(s[10:12]), int(s[12:14])) - _FIRST).days
        date = f"{_FIRST + datetime.timedelta(feistel(day, _DAYS, key, 'date')):%Y%m%d}" if 0 <= day < _DAYS else permute_digits(s[6:14], key, "d8")
    except ValueError:
        date = permute_digits(s[6:14], key, "d8")
    body = permute_digits(s[:6] + s[14:17], key, "resident")
    body = body[:6] + date + body[6:]
    check = lambda b: "10X98765432"[sum(int(d) * (2 ** (17 - i)) for i, d in enumerate(b)) % 11]
    return body + check(body) if check(s[:17]) == s[17].upper() else body + permute_digits(s[17], key, "last") if s[17].isdigit() else body + "X"


def _permute_mixed(values: list[int], sizes: list[int], key: bytes, tag: str) -> list[int]:
    """A keyed permutation of all tuples with 0 <= value < size."""
    whole = 0
    for v, n in zip(values, sizes, strict=True):
        whole = whole * n + v
    whole, out = feistel(whole, math.prod(sizes), key, tag), []
    for n in reversed(sizes):
        whole, v = divmod(whole, n)
        out.append(v)
    return out[::-1]


def _permute_text(s: str, key: bytes, tag: str) -> str:
    """Digits become digits and letters letters (the last of a British insurance number one of A to D)."""
    sets = ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in s]
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", s):
        sets[-1] = "ABCD"
    new = _permute_mixed([x.index(c) for x, c in zip(sets, s, strict=True)], [len(x) for x in sets], key, tag + re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))
    return "".join(x[i] for x, i in zip(sets, new, strict=True))


def _nir(s: str, key: bytes) -> str:
    """A French number: sex, year, month, place and order, check. A valid sex and month stay valid."""
    check = lambda b: f"{97 - int(b) % 97:02d}"
    sexes = "12" if s[0] in "12" else "03456789"
    months = range(1, 13) if 1 <= int(s[3:5]) <= 12 else [0, *range(13, 100)]
    sex, year, month, rest = _permute_mixed([sexes.index(s[0]), int(s[1:3]), months.index(int(s[3:5])), int(s[5:13])], [len(sexes), 100, len(months), 10**8], key, f"nir{len(sexes)}{len(months)}")
    body = f"{sexes[sex]}{year:02d}{months[month]:02d}{rest:08d}"
    return body + (check(body) if check(s[:13]) == s[13:] else permute_digits(s[13:], key, "nir"))


def _tax_check(body: str) -> str:
    """Check digit of ten digits by the public rule ISO 7064, MOD 11,10."""
    product = 10
    for d in body:
        product = 2 * ((int(d) + product) % 10 or 10) % 11
    return str((11 - product) % 10)


def _tax(s: str, key: bytes) -> str:
    body = permute_digits(s[:10], key, "tax")
    return body + (_tax_check(body) if _tax_check(s[:10]) == s[10] else permute_digits(s[10], key, "tax last"))


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """What stands in a placeholder for a value: a number of the same format, or a keyed tag."""
    if kind in ("phone", "id_number"):
        digits, body = re.sub(r"\D", "", value), re.sub(r"[^0-9A-Za-z]", "", value).upper()
        if kind == "phone":
            # A country code stays, so that +49 30 and 0049 30 stay the same number.
            lead = 2 if re.match(r"\+(?!1\d{10}$|1\D)", value) else 1 if value.startswith("+1") else 4 if re.match(r"00(?!1)", value) else 3 if value.startswith("001") else 0
            new, body = digits[:lead] + permute_digits(digits[lead:], key, kind), digits
        elif re.fullmatch(r"\d{17}[\dX]", body):
            return _resident(body, key)
        elif len(body) == len(digits) == 15:
            new = _nir(digits, key)
        elif len(body) == len(digits) == 11:
            new = _tax(digits, key)
        else:
            new = _permute_text(body, key, kind)
        it = iter(new)
        there = str.isdigit if kind == "phone" else lambda c: c.isascii() and c.isalnum()
        return "".join((x if c.isupper() or c.isdigit() else x.lower()) if there(c) and (x := next(it)) else c for c in value)
    tag = re.sub(r"[\s ]+", " ", value).casefold()
    return hashlib.blake2b(tag.encode(), key=key, digest_size=12).hexdigest()


def redact(text: str, names: Names | None, key: bytes) -> str:
    """The text with ``[kind:pseudonym]`` in place of each personal value; all else is unchanged."""
    out, at = [], 0
    for a, b, kind in find(text, names):
        out += [text[at:a], f"[{kind}:{pseudonym(_clean(text[a:b]), kind, key)}]"]
        at = b
    return "".join([*out, text[at:]]) if at else text


def _strings(x):
    if isinstance(x, str):
        yield x
    elif isinstance(x, dict):
        for v in x.values():
            yield from _strings(v)
    elif isinstance(x, list):
        for v in x:
            yield from _strings(v)


def _load(raw: str | None):
    try:
        return json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None


_LITERAL = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)


def redact_json(raw: str | None, names: Names | None, key: bytes) -> str | None:
    """JSON text with its strings redacted; only string literals that hold a value are written anew.

    Text that is no complete JSON is redacted as plain text, so that nothing of it slips through.
    """
    if not raw:
        return raw
    if _load(raw) is None:
        return redact(raw, names, key)

    def one(m: re.Match) -> str:
        was = json.loads(m[0], strict=False)
        now = redact(was, names, key)
        return m[0] if now == was else json.dumps(now, ensure_ascii="\\u" in m[0])

    return _LITERAL.sub(one, raw)


def _finder(known: list[tuple[str, str]], is_json: bool):
    def run(frames):
        names = name_pattern(known)
        for f in frames:
            ids, kinds, values = [], [], []
            for i, raw in zip(f.record_id, f.raw, strict=True):
                texts = _strings(_load(raw)) if is_json else [raw] if raw else []
                seen = {(kind, _clean(t[a:b])) for t in texts for a, b, kind in find(t, names)}
                ids += [i] * len(seen)
                kinds += [k for k, _ in seen]
                values += [v for _, v in seen]
            yield pd.DataFrame({"record_id": ids, "kind": kinds, "found_text": values}, dtype="object")

    return run


def find_personal(df: DataFrame, known: list[tuple[str, str]], is_json: bool) -> DataFrame:
    """(record_id, kind, found_text), distinct, from (record_id, raw). Null ids or texts, empty texts and unreadable JSON give none."""
    found = df.where(F.col("record_id").isNotNull()).select("record_id", "raw").mapInPandas(_finder(known, is_json), "record_id string, kind string, found_text string")
    return found.distinct()


def redacted(df: DataFrame, column: str, known: list[tuple[str, str]], is_json: bool, key: bytes) -> DataFrame:
    """df with the column's texts redacted; null stays null, empty stays empty, rows and other columns are unchanged."""

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        names = name_pattern(known)
        return pd.Series([redact_json(r, names, key) if is_json else redact(r, names, key) if r else r for r in raw], dtype="object")

    return df.withColumn(column, run(F.col(column)))


def _known(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    return sorted((r.name_kind, r.name_text) for r in table(spark, sf_dir, "known_names").dropna().distinct().collect())  # a fixed table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known(spark, sf_dir)
    parts = find_personal(table(spark, sf_dir, "parts").select(F.col("id").alias("record_id"), F.col("data").alias("raw")), known, True)
    lessons = find_personal(table(spark, sf_dir, "memories").select(F.col("id").alias("record_id"), F.col("lesson").alias("raw")), known, False)
    return parts.select(F.lit("parts").alias("record_table"), "*").unionByName(lessons.select(F.lit("memories").alias("record_table"), "*"))


#: Session setting with the secret key of pseudonyms; without it the registered query uses a key that everyone knows.
KEY_SETTING, DEMO_KEY = "spark.sessionloom.pseudonym.key", "sessionloom"


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, key = _known(spark, sf_dir), spark.conf.get(KEY_SETTING, DEMO_KEY).encode()
    parts = table(spark, sf_dir, "parts").select(F.lit("parts").alias("record_table"), F.col("id").alias("record_id"), F.col("data").alias("text"))
    lessons = table(spark, sf_dir, "memories").select(F.lit("memories").alias("record_table"), F.col("id").alias("record_id"), F.col("lesson").alias("text"))
    return redacted(parts, "text", known, True, key).unionByName(redacted(lessons, "text", known, False, key))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
ORACLE: dict[str, str] = {}
