"""Personal information in free text: find it, and put typed placeholders in its place (problem 1).

Five kinds are found: ``email``, ``phone``, ``identity_number``, ``street_address`` and ``person_name``. A placeholder
names its kind and carries a pseudonym: numbers are normalised and permuted by a keyed Feistel network within their format
(by cycle walking: check digits, series, phone patterns and a date inside a number stay valid), other values get a keyed
tag. The same value therefore gets the same placeholder in every document, and the text around it isn't touched.

Names are told by two words side by side that belong to no language's common words, by a list of frequent given names, by
titles and initials, and by given names that the table itself shows beside several surnames. Both passes over the text
column are narrow: rows are independent, so any skew of ids, sources or copies is without effect.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.feistel import permute_date, permute_digits, permute_within
from tidemark.llm.vocabulary import Vocabulary, tokenizer_path
from tidemark.session import free_name

KINDS = ("email", "phone", "identity_number", "street_address", "person_name")

# Given names that public birth statistics of many countries list among the most frequent, lower case.
GIVEN_NAMES = frozenset(
    """
adam ahmed aisha alejandro alexander ali alice amanda amelia amy ana andrea andreas andrew angela anna anne anthony antonio
ashley barbara benjamin bernd betty brian carlos carmen carol caroline catherine charles charlotte chiara christian
christine christopher claudia cynthia daniel david deborah diana diego donald donna dorothy edward elena elizabeth ella
emily emma eric eva fatima felix fernando francesca francesco francisco frank gabriel gary george giulia giuseppe grace
hannah hans hassan heather heinz helen helga henry ibrahim ines ingrid irene isabel isabella ivan jack jacob james jan
jane janet jason javier jean jennifer jessica joan joao john jonas jonathan jorge jose joseph joshua juan julia julie
jürgen karen karin katarzyna katherine kathleen kelly kenneth kevin klaus laura leon linda lisa lucas lucia luis lukas
manuel marco margaret maria marie mario mark martin mary mateo matthew mehmet melissa mia michael michelle miguel
mohamed mohammed monika mustafa nancy natalia nicholas nicole nina noah olga oliver olivia omar pablo pamela patricia
patrick paul paula pedro peter petra philip pierre piotr rachel rebecca renate richard robert rosa ruth samuel sandra sara
sarah sebastian sharon simon sofia sophia stefan stephen steven susan sven teresa thomas victor walter werner william
wolfgang yusuf
""".split()
)
LEARNT = 50_000  # names that are learnt from a table at most, the most frequent ones; the size of what is shipped

# Chinese double surnames, and the most common single ones.
DOUBLE_SURNAMES = "欧阳 上官 司徒 诸葛 慕容 令狐 司马 夏侯 皇甫 尉迟 公孙 长孙 宇文 东方 端木 轩辕 南宫 独孤 百里 呼延 闻人 澹台 淳于 申屠 钟离 西门 拓跋 赫连".split()
SINGLE_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"

# Function words, days and months, which are no surnames even beside a given name.
NOT_SURNAMES = frozenset(
    """
the this that these those there then they please before after would could should shall will can may might must and or but if
for nor not no yes your our their his her its you i we it he she is was are were am be been has have had do does did from with
about into over under in on at of to by as an a so than when where why how which who whom whose what while since until
der die das den dem des ein eine einer und oder nicht ist war sind bitte wir ich sie er es nach von mit für bei el la los las
un una y o no es con por para después que se su como pero street road lane avenue drive court place terrace way crescent
close boulevard square calle rue apt unit monday tuesday wednesday thursday friday saturday sunday january february march
april june july august september october november december
""".split()
)

HAN = "㐀-䶿一-鿿"
WORD = r"[^\W\d_]"

EMAIL = re.compile(
    r"(?<![\w.+%-])(?P<local>[A-Za-z0-9][\w.+%-]{0,63})(?:(?P<at>[@＠])| (?P<spaced>[@＠]) )(?P<host>(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?![\w-])",
    re.ASCII,
)
SPELT_EMAIL = re.compile(
    r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]{0,63}\s*(?:\[at\]|\(at\)|\{at\}|\sat\s)\s*[A-Za-z0-9-]+(?:\s*(?:\[dot\]|\(dot\)|\{dot\}|\sdot\s)\s*[A-Za-z0-9-]+)+(?![\w-])",
    re.IGNORECASE | re.ASCII,
)
# A login stands behind a command, with options, paths and hosts between but no prose.
LOGIN_BEFORE = re.compile(r"(?:\b(?:ssh|scp|sftp|rsync|mosh|sshfs|ssh-copy-id|ftp)(?:\s+(?:-\S+(?:\s+[\w./:=-]*[\d./:=][\w./:=-]*)?|[\w.~-]*[/.:][\w./:~-]*))*\s+[\"']?|://[^\s]*|(?<![\w-])-u\s*|--user[= ])$", re.IGNORECASE)

CUE_BEFORE = re.compile(r"(?:\b(?:seq|run|build|ticket|part|no\.|version|offset|crc|len|job|rev|id|ref|commit|epoch|server|issue|pr)\b[.:#=]?\s*|[=#/\\]\s*)$", re.IGNORECASE)
ID_CUE = re.compile(r"(?:\bssn|social security(?: (?:no|number))?|\bid[_ -]?(?:no|nr|number)|national id)[\s.:=#\"']*$", re.IGNORECASE)
PHONE = re.compile(
    r"""(?<![\w.+/-])(?:tel:)?(?P<n>
      (?:\+|00)\d{1,3}[ .\-/]*(?:\(0\)[ .\-]*)?(?:\(?\d{1,5}\)?[ .\-/]?){1,6}\d(?:[ ](?:ext\.?|x)[ ]?\d{1,5})?
    | (?:1[\-. ])?(?:\([2-9]\d{2}\)[ ]?|[2-9]\d{2}[\-. ])[2-9]\d{2}[\-. ]\d{4}(?:[ ](?:ext\.?|x)[ ]?\d{1,5})?
    | 0\d{1,4}[ /\-](?:\d{2,8}[ \-/]?){1,5}\d{1,8}
    )(?![\w:]|[.\-/]\d)""",
    re.VERBOSE | re.ASCII,
)
CUED_PHONE = re.compile(
    r"(?:\b(?:tel|telephone|phone|mobile|cell|fax|telefon|teléfono|móvil|rufnummer|handy|call)\b\.?:?|电话|手机|致电)[\s:]{0,3}(?P<n>\+?\d[\d ().\-/]{5,17}\d)(?![\w])",
    re.IGNORECASE,
)

DNI = re.compile(r"(?P<d>\d{8})-?(?P<c>[A-Z])(?![\w-])", re.ASCII)
NUMBER = re.compile(r"\d[\d ().\-/]{5,}\d|\d{5,}", re.ASCII)
NIE = re.compile(r"(?P<p>[XYZ])-?(?P<d>\d{7})-?(?P<c>[A-Z])(?![\w-])", re.ASCII)
NINO = re.compile(r"[A-CEGHJ-PQR-TW-Z][A-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w-])", re.ASCII)
SSN = re.compile(r"(?P<a>\d{3})(?P<s>[- ])(?P<g>\d{2})(?P=s)(?P<n>\d{4})(?![\w-])", re.ASCII)
RESIDENT = re.compile(r"(?P<r>\d{6})(?P<y>\d{8})(?P<q>\d{3})(?P<c>[\dXx])(?![A-Za-z0-9_-])", re.ASCII)
CUED_ID = re.compile(
    r"(?:passport(?: (?:no|number|nr)\b\.?)?|reisepass(?:-?nr\.?)?|pass-?nr\.?|pasaporte(?: n[ºo.]+)?|护照号?码?)[\s:#]{0,3}(?P<pass>(?=[A-Z0-9]*\d)[A-Z0-9]{6,12})(?![\w-])"
    r"|(?:tax[ -]?id(?: no\.?)?|tin|steuer-?(?:id|nummer|nr)\.?|idnr\.?|steueridentifikationsnummer|nif|税号)[\s:#]{0,3}(?P<tax>\d[\d /]{7,16}\d)(?![\w-])",
    re.IGNORECASE,
)

STREET_EN = r"(?:street|st|road|rd|lane|ln|avenue|ave|boulevard|blvd|drive|dr|court|ct|place|pl|terrace|way|crescent|close|square|gardens|grove|hill|parade)"
ADDRESS = re.compile(
    rf"""(?<![\w./-])(?:
      (?:(?:unit|apt|flat|suite)[ ]\d{{1,4}}[a-z]?,[ ])?\d{{1,5}}[a-z]?[ ](?:{WORD}{{2,}}[ ]){{1,2}}?{STREET_EN}\b\.?(?:,[ ](?:apt|unit|flat|suite)\b\.?[ ]\d{{1,4}})?(?:,[ ]{WORD}{{3,}}(?:[ ]\d{{4,6}})?)?
    | (?:calle|c/|avenida|avda\.|plaza|paseo|camino)[ ](?:de[ ](?:la[ ]|los[ ]|las[ ])?)?{WORD}{{3,}}(?:[ ]{WORD}{{3,}})?,?[ ]\d{{1,4}}(?:,[ ]\d{{1,2}}[ ]?º(?:[ ]?[A-Z]\b)?)?(?:,[ ]\d{{4,5}}[ ]{WORD}{{3,}})?
    | \d{{1,4}}[ ]?(?:bis[ ]|ter[ ])?,?[ ]?(?:rue|avenue|boulevard|impasse|allée|chemin|quai|place)[ ](?:de[ ]la[ ]|de[ ]l'|des[ ]|du[ ]|de[ ]|d')?{WORD}{{3,}}(?:,[ ]\d{{5}}[ ]{WORD}{{3,}})?
    | {WORD}{{2,}}(?:str\.|straße|strasse|weg|allee|platz|gasse|damm|ufer)[ ]\d{{1,4}}[a-z]?(?:,[ ]\d{{5}}[ ]{WORD}{{3,}})?
    | [{HAN}]{{2,8}}(?:路|街|大道|巷|弄)\d{{1,5}}号(?:[{HAN}\d]{{0,12}}[室楼层栋])?
    )(?![\w])""",
    re.VERBOSE | re.IGNORECASE,
)
HINTS = {
    "spelt": "[at] (at) {at} [at (at {at at] at) at} dot] dot) dot}".split() + [" dot "],
    "id": "passport reisepass pass-nr pasaporte 护照 tax id tax-id taxid tin steuer idnr nif 税号".replace("tax id", "tax_id").split(),
    "phone": "tel phone mobile cell fax móvil rufnummer handy call 电话 手机 致电".split(),
    "street": [
        *(" " + w for w in "street road lane avenue boulevard drive court place terrace way crescent close square gardens grove hill parade".split()),
        *(w + x for w in (" st", " rd", " ln", " ave", " blvd", " dr", " ct", " pl") for x in (" ", ".", ",", ";", "\n", '"', "'", ")")),
        *"calle avenida avda. plaza paseo camino c/ rue avenue boulevard impasse allée chemin quai str. straße strasse weg allee platz gasse damm ufer 路 街 大道 巷 弄".split(),
    ],
    "title": "mr mrs ms mx dr prof herr frau sr sra srta mme don doña señor señora monsieur madame sir lady".split(),
}
HINTS["id"] = [w.replace("_", " ") for w in HINTS["id"]]
INITIAL = re.compile(r"[A-ZÀ-ÖØ-Þ]\.[ ]?[A-ZÀ-ÖØ-Þ]")

SURNAME = rf"[A-ZÀ-ÖØ-Þ]{WORD}{{2,}}(?:-[A-ZÀ-ÖØ-Þ]{WORD}{{2,}})?(?![\w]|-\w|/|\.\w)"
AFTER_GIVEN = re.compile(rf"(?:[ ](?P<i>[A-Z])\.)?[ ](?P<s>{WORD}{{3,}}(?:-{WORD}{{3,}})?)(?![\w(=/]|-\w|\.\w)")
BEFORE_GIVEN = re.compile(rf"(?<![\w./-])(?P<s>{WORD}{{3,}}(?:-{WORD}{{3,}})?),[ ]$")
NAME_PAIR = re.compile(rf"(?<![\w./@+#'-])(?P<g>[A-ZÀ-ÖØ-Þ]{WORD}{{2,}})[ ](?:[A-Z]\.[ ])?(?P<s>[A-ZÀ-ÖØ-Þ]{WORD}{{2,}}(?:-[A-ZÀ-ÖØ-Þ]{WORD}{{2,}})?)(?![\w(=/:]|-\w|\.\w)")
TITLED = re.compile(
    rf"(?<![\w.-])(?:(?:Mr|Mrs|Ms|Mx|Dr|Prof|Herr|Frau|Sr|Sra|Srta|Mme|Don|Doña|Señora?|Monsieur|Madame|Sir|Lady)\b\.?[ ]){{1,2}}(?:{WORD}+[ ])?(?P<s>{SURNAME})"
    rf"|(?<![\w.'-])(?<!\d )(?<!º )(?P<i>[A-ZÀ-ÖØ-Þ])\.[ ]?(?:[A-Z]\.[ ]?)?(?P<s2>{SURNAME})"
)
HAN_NAME = re.compile(
    rf"(?<![{HAN}])(?:{'|'.join(DOUBLE_SURNAMES)})[{HAN}]{{1,2}}(?![{HAN}])"
    rf"|(?:{'|'.join(DOUBLE_SURNAMES)})[{HAN}]{{2}}(?=负责|说|先生|女士|老师|经理|的|已|在|和|把)"
    rf"|(?<![{HAN}])[{SINGLE_SURNAMES}][{HAN}]{{2}}(?=\s?(?:负责|先生|女士|老师|经理|说过|来电))"
    rf"|(?<=联系|找到|同事|客户|姓名)[{SINGLE_SURNAMES}][{HAN}]{{2}}(?![{HAN}])"
)

DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
RESIDENT_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
RESIDENT_CHECKS = "10X98765432"


def _resident_check(first17: str) -> str:
    return RESIDENT_CHECKS[sum(int(a) * b for a, b in zip(first17, RESIDENT_WEIGHTS, strict=True)) % 11]


def _as_date(yyyymmdd: str) -> dt.date | None:
    try:
        return dt.date(int(yyyymmdd[:4]), int(yyyymmdd[4:6]), int(yyyymmdd[6:]))
    except ValueError:
        return None


def _filled(value: str, digits: str) -> str:
    """``value`` with its digits replaced in order, and all other signs in place."""
    new = iter(digits)
    return "".join(next(new) if c.isdecimal() and c.isascii() else c for c in value)


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdecimal() and c.isascii())


def _same_format(value: str, key: bytes, valid: Callable[[str], bool] = lambda d: True) -> str:
    """``value`` with its digits permuted together, within those that are ``valid``."""
    return _filled(value, permute_within(_digits(value), key, valid))


def _ssn_valid(like: str) -> Callable[[str], bool]:
    """The nine digits that are numbers of the same series: social security, or taxpayers' (beginning with 9)."""
    return lambda d: (d[0] == "9") == (like[0] == "9") and d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000"


def _tax_check(first10: str) -> str:
    """The check digit of an eleven-digit tax number (ISO 7064, mod 11, 10)."""
    p = 10
    for c in first10:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return str((11 - p) % 10)


def _tax_pseudonym(value: str, key: bytes) -> str:
    d = _digits(value)
    if len(d) == 11 and d[0] != "0" and _tax_check(d[:10]) == d[10]:
        first = permute_within(d[:10], key, lambda x: x[0] != "0")
        return _filled(value, first + _tax_check(first))
    return _same_format(value, key)


# Telephone country codes of one and of two digits; all others have three.
SHORT_COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def phone_parts(number: str) -> tuple[int, int, bool]:
    """Where the national number lies among the digits of a phone number (start, end), and whether it is North American.

    International prefix, country code and the trunk zero come before it, an extension after it.
    """
    main = re.split(r" ?(?:ext\.?|x)", number, flags=re.IGNORECASE)[0]
    d = _digits(main)
    start, code = 0, ""
    if main.lstrip().startswith("+") or d.startswith("00"):
        start = 0 if main.lstrip().startswith("+") else 2
        code = next((d[start : start + n] for n in (1, 2) if d[start : start + n] in SHORT_COUNTRY_CODES), d[start : start + 3])
        start += len(code)
    elif len(d) == 11 and d[0] == "1":
        start, code = 1, "1"
    american = code in ("", "1") and len(d) - start == 10 and d[start] in "23456789"
    if not american and d[start : start + 1] == "0":
        start += 1
    return start, len(d), american


def _phone_pseudonym(number: str, key: bytes) -> str:
    """A number of the same country and region: equal numbers get equal ones, however they are written.

    A North American number keeps to its pattern; of any other the first two digits of the national number stay.
    """
    d = _digits(number)
    start, end, american = phone_parts(number)
    national = d[start:end]
    if american:
        new = permute_within(national, key, lambda x: x[0] in "23456789" and x[3] in "23456789")
    else:
        new = national[:2] + permute_digits(national[2:], key)
    return _filled(number, d[:start] + new + permute_digits(d[end:], key))


def _tag(kind: str, value: str, key: bytes) -> str:
    plain = " ".join(re.sub(r"[^\w@]+", " ", value.replace("＠", "@").lower()).split())
    return hashlib.blake2b(f"{kind}|{plain}".encode(), key=key, digest_size=5).hexdigest()


def _lower(text: str) -> str:
    """Lower case with every sign at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _free_left(text: str, at: int, barred: str = "_-") -> bool:
    """Whether no letter, digit or barred sign stands before ``at``."""
    return at == 0 or not (text[at - 1].isascii() and text[at - 1].isalnum() or text[at - 1] in barred)


class Finder:
    """Finds personal information in one text after another; holds the compiled word list.

    One pass of an automaton over the lower-cased text says which of the costlier searches can find anything.
    """

    def __init__(self, key: bytes, learnt: Iterable[str] = (), vocabulary: Vocabulary | None = None) -> None:
        self.key = key
        self.common = vocabulary or Vocabulary()
        self.names = GIVEN_NAMES | set(learnt)
        self.words = ahocorasick.Automaton()
        groups: dict[str, list[str]] = {}
        for group, words in [*HINTS.items(), ("given", sorted(self.names))]:
            for word in words:
                groups.setdefault(word, []).append(group)
        for word, found in groups.items():
            self.words.add_word(word, (len(word), tuple(found)))
        self.words.make_automaton()

    def _emails(self, text: str, spelt: bool) -> Iterator[tuple[int, int, str, str]]:
        if "@" in text or "＠" in text:
            for m in EMAIL.finditer(text):
                before, after = text[max(0, m.start() - 120) : m.start()], text[m.end() : m.end() + 2]
                line = before[before.rfind("\n") + 1 :]
                if m["local"].lower() == "git" or (after[:1] == ":" and after[1:2].strip() and not after[1:2].isdecimal() and m["at"]) or LOGIN_BEFORE.search(line):
                    continue
                if before.endswith(("://", ":")) and re.search(r"\w+://\S*$", line):
                    continue
                yield m.start(), m.end(), "email", _tag("email", m[0], self.key)
        if spelt:
            for m in SPELT_EMAIL.finditer(text):
                plain = re.sub(r"\s*[\[({]at[\])}]\s*|\sat\s", "@", re.sub(r"\s*[\[({]dot[\])}]\s*|\sdot\s", ".", m[0], flags=re.I), flags=re.I)
                yield m.start(), m.end(), "email", _tag("email", plain, self.key)

    def _numbers(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        key = self.key
        for m in RESIDENT.finditer(text):
            day = _as_date(m["y"])
            if day and _free_left(text, m.start()) and 1900 <= day.year < 2100 and _resident_check(m[0][:17]) == m["c"].upper():
                first = m["r"][:2] + permute_digits(m["r"][2:], key) + permute_date(day, key).strftime("%Y%m%d") + permute_digits(m["q"], key)
                yield m.start(), m.end(), "identity_number", first + _resident_check(first)
        for m in DNI.finditer(text):
            if DNI_LETTERS[int(m["d"]) % 23] == m["c"] and _free_left(text, m.start()):
                digits = permute_digits(m["d"], key)
                yield m.start(), m.end(), "identity_number", m[0].replace(m["d"], digits)[:-1] + DNI_LETTERS[int(digits) % 23]
        for m in NIE.finditer(text):
            if DNI_LETTERS[int(str("XYZ".index(m["p"])) + m["d"]) % 23] == m["c"] and _free_left(text, m.start()):
                digits = permute_digits(m["d"], key)
                yield m.start(), m.end(), "identity_number", m["p"] + digits + DNI_LETTERS[int(str("XYZ".index(m["p"])) + digits) % 23]
        for m in NINO.finditer(text):
            if _free_left(text, m.start()):
                yield m.start(), m.end(), "identity_number", _same_format(m[0], key)
        for m in SSN.finditer(text):
            if _free_left(text, m.start(), "_-.") and m["a"] not in ("000", "666") and m["g"] != "00" and m["n"] != "0000" and self._told(text, m.start()):
                yield m.start(), m.end(), "identity_number", _same_format(m[0], key, _ssn_valid(_digits(m[0])))

    @staticmethod
    def _told(text: str, at: int) -> bool:
        """Whether what stands before a number doesn't make it a number of something else."""
        before = text[max(0, at - 32) : at]
        return ID_CUE.search(before) is not None or CUE_BEFORE.search(before[-16:]) is None

    def _cued(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        for m in CUED_ID.finditer(text):
            at = "pass" if m["pass"] else "tax"
            if at == "pass" or 9 <= sum(c.isdecimal() for c in m[at]) <= 13:
                yield m.start(at), m.end(at), "identity_number", _same_format(m[at], self.key) if at == "pass" else _tax_pseudonym(m[at], self.key)

    def _phones(self, text: str, cued: bool) -> Iterator[tuple[int, int, str, str]]:
        for rx in (PHONE, CUED_PHONE) if cued else (PHONE,):
            for m in rx.finditer(text):
                n = re.split(r" (?:ext|x)", m["n"])[0]
                digits = sum(c.isdecimal() for c in n)
                if not 8 <= digits <= 15 or (rx is PHONE and CUE_BEFORE.search(text[max(0, m.start() - 16) : m.start()])):
                    continue
                if n[0] == "0" and n[1] != "0" and not 9 <= digits <= 12:
                    continue
                yield m.start("n"), m.end("n"), "phone", _phone_pseudonym(m["n"], self.key)

    def _addresses(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        for m in ADDRESS.finditer(text):
            yield m.start(), m.end(), "street_address", _tag("street_address", m[0], self.key)

    def _given(self, text: str, ends: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, str]]:
        for start, end in ends:
            if start and (text[start - 1].isalnum() or text[start - 1] in "_@./+-") or end < len(text) and (text[end].isalnum() or text[end] in "_@/+-"):
                continue
            shape = text[start:end]
            style = "title" if shape.istitle() else "upper" if shape.isupper() else "lower" if shape.islower() else ""
            m = AFTER_GIVEN.match(text, end)
            if m and style and self._fits(m["s"], style):
                yield start, m.end(), "person_name", _tag("person_name", text[start : m.end()], self.key)
                continue
            m = BEFORE_GIVEN.search(text[max(0, start - 60) : start])
            if m and style and self._fits(m["s"], style):
                yield start - len(m[0]), end, "person_name", _tag("person_name", f"{text[start:end]} {m['s']}", self.key)

    def _titled(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        for m in TITLED.finditer(text):
            s = m["s"] or m["s2"]
            if s.lower() not in NOT_SURNAMES and not (m["i"] and (not s[1:].islower() and "-" not in s)) and not re.search(r"\d[a-z]? \w+ $", text[max(0, m.start() - 30) : m.start()]):
                yield m.start(), m.end(), "person_name", _tag("person_name", m[0], self.key)

    def _han(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        for m in HAN_NAME.finditer(text):
            yield m.start(), m.end(), "person_name", _tag("person_name", m[0], self.key)

    def _fits(self, surname: str, style: str) -> bool:
        """Whether a word is written as the given name beside it, and can be a surname."""
        low = surname.lower()
        if low in NOT_SURNAMES:
            return False
        parts = surname.split("-")
        if style == "title":
            return all(p.istitle() or p[0].isupper() and p[1:].islower() for p in parts)
        if style == "upper":
            return surname.isupper() and not any(p in self.common.plain for p in low.split("-"))
        return surname.islower() and len(surname) >= 5 and not any(p in self.common.words for p in parts)

    def pairs(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Start, end and first word of two capitalised words side by side of which neither is a word of any language.

        They read as a name whether or not anybody has listed it; names of things mostly end in a common noun.
        """
        at = 0
        while m := NAME_PAIR.search(text, at):
            first, parts = m["g"].lower(), m["s"].lower().split("-")
            plain = first in self.common.plain or first in NOT_SURNAMES or any(p in self.common.words or p in NOT_SURNAMES for p in parts)
            at = m.start("s") if plain else m.end()
            if not plain and m["g"][1:].islower() and all(p[1:].islower() for p in m["s"].split("-")):
                yield m.start(), m.end(), first

    def _unlisted(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        for start, end, _ in self.pairs(text):
            yield start, end, "person_name", _tag("person_name", text[start:end], self.key)

    def find(self, text: str | None) -> list[tuple[int, int, str, str]]:
        """Start, end, kind and pseudonym of what is found, in order and without overlap; the longest wins."""
        if not text:
            return []
        hints: set[str] = set()
        given = []
        for last, (length, groups) in self.words.iter(_lower(text)):
            hints.update(groups)
            if "given" in groups:
                given.append((last + 1 - length, last + 1))
        found = [*self._emails(text, "spelt" in hints)]
        if NUMBER.search(text):
            found += [*self._numbers(text), *self._phones(text, "phone" in hints)]
        if "id" in hints:
            found += self._cued(text)
        if "street" in hints:
            found += self._addresses(text)
        if given:
            found += self._given(text, given)
        found += self._unlisted(text)
        if "title" in hints or INITIAL.search(text):
            found += self._titled(text)
        if not text.isascii():
            found += self._han(text)
        if len(found) < 2:
            return found
        kept: list[tuple[int, int, str, str]] = []
        for one in sorted(found, key=lambda x: (x[0] - x[1], x[0], KINDS.index(x[2]))):
            if all(one[1] <= k[0] or one[0] >= k[1] for k in kept):
                kept.append(one)
        return sorted(kept)

    def redact(self, text: str | None) -> tuple[str | None, list[tuple[int, int, str, str]]]:
        found = self.find(text)
        if not found:
            return text, found
        out, at = [], 0
        for start, end, kind, pseudonym in found:
            out += [text[at:start], f"[{kind.upper()} {pseudonym}]"]
            at = end
        return "".join([*out, text[at:]]), found


def learn_names(df: DataFrame, text: str, *, paths: tuple[str, ...] | None = None, most: int = LEARNT) -> list[str]:
    """Given names of a table: the first words of at least two different pairs that read as names (:meth:`Finder.pairs`).

    They make it possible to know a name again in lower case or behind the surname. Every text counts; the pairs are
    aggregated, and the ``most`` frequent names are what is shipped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(b"", vocabulary=Vocabulary.shared(paths))
        for batch in batches:
            found = {(first, t[start:end].rsplit(" ", 1)[-1].lower()) for t in batch.column(0).to_pylist() if t for start, end, first in finder.pairs(t)}
            cols = list(zip(*sorted(found), strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string())], names=["given", "surname"])

    pairs = df.select(F.col(text).cast("string")).mapInArrow(run, "given string, surname string").distinct()
    counted = pairs.groupBy("given").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "given").limit(most)
    return [r["given"] for r in counted.collect()]


def redact_personal(df: DataFrame, text: str, key: str, *, redacted: str = "text_redacted", found: str = "pii_found", names: list[str] | None = None, paths: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with the text without personal information, and what was found where.

    Adds ``redacted`` (string) and ``found`` (array of ``start``, ``end``, ``kind``, ``pseudonym``; code point offsets
    into the given text). Who has the ``key`` can undo the permutations of numbers, so it is no part of the program. A
    null text gives null and an empty array, an empty text stays empty, texts of any length are read as a whole, equal
    rows give equal results and an empty table gives an empty one. Columns of ``df`` that bear one of the new names are
    replaced. ``names`` are given names learnt before, else those of this table; ``paths`` are vocabularies of
    public tokenizers, from which it is known what a common word is.
    """
    secret = key.encode()[:64]
    if not secret:
        raise ValueError("a key is needed")
    learnt = learn_names(df, text, paths=paths) if names is None else names

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Finder(secret, learnt, Vocabulary.shared(paths))
        for texts in batches:
            both = [finder.redact(x) for x in texts]
            spans = [[dict(zip(("start", "end", "kind", "pseudonym"), x, strict=True)) for x in b] for _, b in both]
            yield pd.DataFrame({redacted: [a for a, _ in both], found: spans})

    run = F.pandas_udf(run, f"struct<{redacted}: string, {found}: array<struct<start: int, end: int, kind: string, pseudonym: string>>>")
    keep = [c for c in df.columns if c not in (redacted, found)]
    both = free_name(df, "both")
    return df.select(*keep, run(F.col(text)).alias(both)).select(*keep, f"{both}.{redacted}", f"{both}.{found}")


def find_personal(df: DataFrame, record_id: str, text: str, *, names: list[str] | None = None, paths: tuple[str, ...] | None = None) -> DataFrame:
    """``record_id`` (long) and ``pii_kind``: each kind once for a row whose text holds it.

    Null and empty texts give no row; a repeated row gives its kinds once for each copy; other columns aren't read.
    """
    learnt = learn_names(df, text, paths=paths) if names is None else names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(b"", learnt, Vocabulary.shared(paths))
        for batch in batches:
            ids, kinds = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind in sorted({x[2] for x in finder.find(t)}):
                    ids.append(i)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], names=["record_id", "pii_kind"])

    return df.select(F.col(record_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "record_id long, pii_kind string")
