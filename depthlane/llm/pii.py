"""PII: detected entities receive keyed, type-consistent surrogates.

Found are e-mail addresses, telephone numbers, IP addresses of either version, payment-card and IBAN numbers, US
social-security numbers, secrets (values of token-like keys, known key prefixes) and names: after a title or an
introduction, before one in Chinese, Japanese and Korean, or begun by a listed given name or surname.

A surrogate is a keyed permutation of the values that share the entity's type and format: each letter stays a letter of its
script and case, each digit a digit, punctuation stays. Valid check digits of cards and IBANs stay valid and invalid ones
invalid, a card stays with its network (first digit), an address within its special range (private, link-local,
documentation and so on) or outside all of them. The permutation is a Feistel network over the mixed-radix number
of the symbols, used as x -> P'(P(x) + c): a bijection without fixed points; where only some values are of the type it is
followed until the next of them, which is a bijection of those. So equal entities get equal surrogates in all
documents (coreference), different entities different ones, and none keeps its value; nothing has to be gathered, however
large the corpus. Names map to names of the same gender and script, word by word: a given name by permutation of a name list
where it is listed, else by its letters, vowels to vowels and consonants to consonants, with the ending that marks the
gender kept; particles stay. Both operators check over the distinct entities of the corpus
that surrogates are distinct and equal entities have equal ones, and fail where not; originals reach that check, and the
shared folder, as keyed hashes only.

The key comes from the caller or from the session's depthlane.pii.key; without one the operators refuse to run. Null texts stay null and have no entities; texts
without entities return unchanged, byte for byte. Repeated rows are treated alike. An empty table gives no rows. Other
columns pass through `redact` untouched.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left, insort
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, ship
from .rows import keys, source

# Given names by gender and script, and the words before a name.
GIVEN = {
    ("f", "latin"): "Alice Amelia Anna Carla Carmen Caroline Claire Clara Diana Elena Elisa Emily Emma Eva Grace Hannah Helen Ines Isabel Jane Julia Karin Laura Lucia Maria Marie Martha Mary Monika Nina Olivia Paula Petra Rosa Sarah Silvia Sofia Sophie Susan Ursula".split(),
    ("m", "latin"): "Adam Albert Andreas Antoine Antonio Arthur Bernd Carlos Charles Daniel David Diego Edward Felix Frank Georg George Hans Henri Hugo James Jan Javier John Juan Julien Karl Louis Lukas Manuel Martin Michael Miguel Oliver Pablo Paul Peter Pierre Robert Thomas".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Юлия".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Сергей".split(),
}
FEMALE_TITLES = "Mrs Ms Miss Madam Madame Mme Mademoiselle Mlle Frau Señora Sra Señorita Srta Doña Signora г-жа госпожа".split()
MALE_TITLES = "Mr Mister Sir Monsieur Herr Señor Sr Don Signor г-н господин".split()
NEUTRAL_TITLES = "Dr Prof Professor".split()
INTRODUCTIONS = ["my name is", "je m'appelle", "ich heiße", "mein Name ist", "me llamo", "mi nombre es", "меня зовут"]
SURNAMES = "田中 佐藤 鈴木 高橋 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 清水 山崎 池田 欧阳 司马 诸葛 上官".split()
#: Networks of special use: fixed values. An address of one stays in it.
SPECIAL = {4: "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split(),
           6: "fe80::/10 fc00::/7 ff00::/8 2001:db8::/32 2000::/3".split()}
_NETWORKS = {v: [ipaddress.ip_network(n) for n in own] for v, own in SPECIAL.items()}
ALPHABETS = {
    "digit": "0123456789", "hex": "0123456789abcdef", "latin": "abcdefghijklmnopqrstuvwxyz", "accented": "àáâãäåæçèéêëìíîïñòóôõöøùúûüý",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
} | {name: "".join(map(chr, range(a, b + 1))) for name, a, b in (("hiragana", 0x3041, 0x3096), ("katakana", 0x30A1, 0x30FA), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7A3))}
_PLACE = {c: (name, i) for name, own in ALPHABETS.items() if name != "hex" for i, c in enumerate(own)}
_VOWELS = "aeiouàáâãäåæèéêëìíîïòóôõöøùúûüýαεηιουωаеиоуыэюя"
ENDING = {"latin": 1, "accented": 1, "greek": 1, "cyrillic": 2}  # letters at the end of a name's word that mark its gender
for _name_ in ENDING:  # of names, vowels and consonants apart
    for _kind, _own in (("v", [c for c in ALPHABETS[_name_] if c in _VOWELS]), ("c", [c for c in ALPHABETS[_name_] if c not in _VOWELS])):
        ALPHABETS[f"{_name_}-{_kind}"] = "".join(_own)
_SOUND = {c: (name, i) for name, own in ALPHABETS.items() if name[-2:] in ("-v", "-c") for i, c in enumerate(own)}

# A name: initials and capitalised words that are no titles, with particles before any of them.
_UPPER = "[" + "".join(c for c in map(chr, range(0x10000)) if c.isupper() or c.istitle()) + "]"
_PARTICLE = "(?:(?:von|van)(?: (?:der|den|dem|de|het|zu))?|de(?: (?:la|las|los|le))?|del|della|di|da|das|dos|du|des|y|bin|ibn|ben|al|el|ter|ten|zu|af|av)"
_WORD = rf"(?!(?:{'|'.join(FEMALE_TITLES + MALE_TITLES + NEUTRAL_TITLES)})\b)(?:[dlDL]['’])?{_UPPER}(?:[^\W\d_]+|(?=['’-][^\W\d_]))(?:[-'’][^\W\d_]+)*"
_PART = rf"(?:{_PARTICLE} )*(?:{_UPPER}\.(?:-?{_UPPER}\.)*|{_UPPER}(?= {_UPPER}[^\W\d_])|{_WORD})"
_NAME = rf"{_PART}(?: {_PART})*"
_GENDER = {name: gender for (gender, _), own in GIVEN.items() for name in own}
_HAN, _KANA, _HANGUL = "[一-鿿々]", "[ぁ-ゖァ-ヺー]", "[가-힣]"
_PATTERNS = [
    ("email", re.compile(r"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")),
    ("secret", re.compile(r"""(?i:\b(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|passwd|password|pwd)\b["']?\s*[=:]\s*["']?)([A-Za-z0-9+/_\-]{8,}={0,2})""")),
    ("secret", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{35})\b")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,4}(?!\w)")),
    ("phone", re.compile(r"(?<![\w+])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[.-]\d{4}(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w-])\d{4}(?:([ -]?)\d{4}(?:\1\d{4}){2}|[ -]\d{6}[ -]\d{5}|\d{9,15})(?![\w-])")),
    ("ip6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")),
    ("name_f", re.compile(rf"(?<!\w)(?:{'|'.join(FEMALE_TITLES)})\.? ({_NAME})")),
    ("name_m", re.compile(rf"(?<!\w)(?:{'|'.join(MALE_TITLES)})\.? ({_NAME})")),
    ("name", re.compile(rf"(?<!\w)(?:(?:{'|'.join(NEUTRAL_TITLES)})\.?|(?i:{'|'.join(INTRODUCTIONS)})) ({_NAME})")),
    ("given", re.compile(rf"(?<!\w)({_UPPER}[^\W\d_]+(?: {_PART})+)")),
    ("name", re.compile(rf"(?<!{_HAN})({_HAN}{{1,6}}|{_HAN}{{1,4}}{_KANA}{{1,4}}|[ァ-ヺー]{{2,8}})(?=さん|様|氏|くん|ちゃん)")),
    ("name", re.compile(rf"({_HAN}{{2,3}})(?=先生|女士|小姐|太太|教授)")),
    ("name", re.compile(rf"(?:我叫|我的名字是|名叫)({_HAN}{{2,4}})")),
    ("name", re.compile(rf"(?:の名前は)((?:{_HAN}|{_KANA}){{2,10}}?)(?=です|と申|とい|と言|[^一-鿿々ぁ-ゖァ-ヺー]|$)")),
    ("name", re.compile(rf"({_HANGUL}{{2,4}}?)(?= ?씨|님)|(?:이름은 )({_HANGUL}{{2,4}}?)(?=입니다|이에요|예요|$)")),
    ("name", re.compile(rf"(?<!{_HAN})((?:{'|'.join(SURNAMES)}){_HAN}{{1,3}})(?!{_HAN})")),
]

#: What a text must hold for the pattern at the same place to match at all; far cheaper to look for than the pattern.
_NEEDS = [re.compile(n) if n else None for n in ("@", "[=:]", None, r"\d\d", r"\d\.\d", r"\+\d", r"\d{3}[.-]\d{4}", r"\d-\d\d-\d", r"\d{4}", ":[0-9A-Fa-f]*:", None, None, None, None, *[f"{_HAN}|{_KANA}|{_HANGUL}"] * 6)]


def _is_one(kind: str, value: str) -> bool:
    """Whether what a pattern found is an entity, where the pattern alone cannot tell."""
    if kind == "ip6":
        try:
            # "ab::cd" may be a name in a program; neither the unspecified address nor the host itself tells anything
            return int(ipaddress.IPv6Address(value)) > 1 and any(c.isdigit() for c in value) and max(map(len, value.split(":"))) > 2
        except ValueError:
            return False
    return kind != "given" or value.split(" ", 1)[0] in _GENDER


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of entities, in order, not overlapping; of two that overlap the one listed first in _PATTERNS."""
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []  # in order, not overlapping
    for (kind, pattern), need in zip(_PATTERNS, _NEEDS, strict=True):
        if need and not need.search(text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(m.lastindex) if m.lastindex and kind != "card" else m.span()
            if not _is_one(kind, text[a:b]):
                continue
            at = bisect_left(taken, (a, b))
            if (at == len(taken) or b <= taken[at][0]) and (at == 0 or taken[at - 1][1] <= a):
                found.append((a, b, f"name_{_GENDER[text[a:b].split(' ', 1)[0]]}" if kind == "given" else kind))
                insort(taken, (a, b))
    return sorted(found)


class Permutation:
    """A keyed bijection without fixed points on range(size), by a Feistel network with cycle walking."""

    def __init__(self, secret: bytes, tweak: str, size: int):
        self.size, self.tweak, self.secret = size, tweak.encode(), hashlib.blake2b(secret, digest_size=32).digest()
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.shift = 1 + self._digest(b"shift", 64) % (size - 1) if size > 1 else 0

    def _digest(self, data: bytes, bits: int) -> int:
        out = b""
        for n in range(-(-bits // 512)):
            out += hashlib.blake2b(self.tweak + b"\0" + n.to_bytes(2, "big") + data, key=self.secret, digest_size=64).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _rounds(self, x: int, order) -> int:
        mask = (1 << self.half) - 1
        a, b = x >> self.half, x & mask
        for r in order:
            if r >= 0:
                a, b = b, a ^ self._digest(bytes([r]) + b.to_bytes(self.half // 8 + 1, "big"), self.half)
            else:
                a, b = b ^ self._digest(bytes([-1 - r]) + a.to_bytes(self.half // 8 + 1, "big"), self.half), a
        return a << self.half | b

    def _walk(self, x: int, order) -> int:
        x = self._rounds(x, order)
        while x >= self.size:
            x = self._rounds(x, order)
        return x

    def __call__(self, x: int) -> int:
        if self.size < 2:
            return x
        return self._walk((self._walk(x, range(8)) + self.shift) % self.size, range(-8, 0))


def _symbols(value: str, digits_only: bool = False, hexadecimal: bool = False, name: bool = False) -> list[tuple[int, str, int]]:
    """(position, alphabet, place in it) of the symbols that are replaced; case and all else stay."""
    out = []
    kept = ENDING.get(_PLACE.get(value[-1:].lower(), ("",))[0], 0) if name else 0  # of words long enough to keep an ending
    last = len(value) - (kept if len(value) >= 2 * kept + 1 else 0)
    for k, c in enumerate(value[:last]):
        low = c.lower()
        if name and low in _SOUND:
            out.append((k, *_SOUND[low]))
        elif hexadecimal and low in ALPHABETS["hex"]:
            out.append((k, "hex", ALPHABETS["hex"].index(low)))
        elif low in _PLACE and len(low) == 1 and (not digits_only or c.isdigit()):
            out.append((k, *_PLACE[low]))
    return out


def _permuted(secret: bytes, kind: str, value: str, digits_only=False, hexadecimal=False, name=False) -> str:
    symbols = _symbols(value, digits_only, hexadecimal, name)
    if not symbols:
        return value
    size, x = 1, 0
    for _, name, i in symbols:
        size, x = size * len(ALPHABETS[name]), x * len(ALPHABETS[name]) + i
    x = Permutation(secret, f"{kind}:{','.join(name for _, name, _ in symbols)}", size)(x)
    out = list(value)
    for k, name, _ in reversed(symbols):
        x, i = divmod(x, len(ALPHABETS[name]))
        c = ALPHABETS[name][i]
        out[k] = c.upper() if value[k].isupper() else c
    return "".join(out)


def _listed(word: str) -> str | None:
    """The listed given name that this word writes, capitalised or in capitals."""
    return own if (own := word.capitalize()) in _GENDER and word in (own, own.upper()) else None


def _name(secret: bytes, value: str) -> str:
    out = []
    for word in value.split(" "):
        if word.islower():  # a particle
            out.append(word)
        elif own := _listed(word):
            names = next(x for x in GIVEN.values() if own in x)
            new = names[Permutation(secret, f"given:{names[0]}", len(names))(names.index(own))]
            out.append(new.upper() if word.isupper() else new)
        else:
            out.append(_until(lambda x: not _listed(x), secret, "name", word, name=True))  # those are surrogates of listed names
    return " ".join(out)


def _sum10(digits: str) -> int:
    """The checksum of a card number, 0 where its last digit fits."""
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10


def _rest97(account: str) -> int:
    """The remainder of an IBAN, 1 where its check digits fit."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _spread(pattern: str, symbols: str) -> str:
    """The symbols in the places of the pattern's letters and digits."""
    source = iter(symbols)
    return "".join(next(source) if c.isalnum() else c for c in pattern)


def _until(wanted, secret: bytes, kind: str, value: str, **options) -> str:
    new = _permuted(secret, kind, value, **options)
    while not wanted(new) and new != value:
        new = _permuted(secret, kind, new, **options)
    return new


def _card(secret: bytes, value: str) -> str:
    digits = "".join(c for c in value if c.isdigit())
    if _sum10(digits):  # the whole permutation walks over numbers that do not fit either
        return _spread(value, digits[0] + _until(lambda x: _sum10(digits[0] + x), secret, "card", digits[1:]))
    body = digits[0] + _permuted(secret, "card-fit", digits[1:-1])
    return _spread(value, body + str(-_sum10(body + "0") % 10))


def _iban(secret: bytes, value: str) -> str:
    plain = value.replace(" ", "")
    if _rest97(plain) != 1:
        return _spread(value, plain[:2] + _until(lambda x: _rest97(plain[:2] + x) != 1, secret, "iban", plain[2:]))
    body = _permuted(secret, "iban-fit", plain[4:])
    return _spread(value, f"{plain[:2]}{98 - _rest97(plain[:2] + '00' + body):02d}{body}")


def _address(secret: bytes, value: str, version: int) -> str:
    """Within its special network, by its host part; else anywhere outside them."""
    plain = ".".join(str(int(p)) for p in value.split(".")) if version == 4 else value
    address = ipaddress.ip_address(plain)
    own = next((n for n in _NETWORKS[version] if address in n), None)
    inside = lambda x: next((n for n in _NETWORKS[version] if type(address)(x) in n), None)
    first, size = (int(own.network_address), own.num_addresses) if own else (0, 1 << address.max_prefixlen)
    permutation, x = Permutation(secret, f"ip{version}:{own}", size), int(address)
    while True:  # 2000::/3 holds the documentation network, and outside all networks some addresses are of none
        x = first + permutation(x - first)
        if inside(x) == own and (version == 4 or x > 1):
            break
    new = str(type(address)(x))
    return new.upper() if any(c.isupper() for c in value) else new


@lru_cache(maxsize=50_000)
def surrogate(secret: bytes, kind: str, value: str) -> str:
    """The replacement of one entity, a function of key, type and value only."""
    if kind in ("ip", "ip6"):
        return _address(secret, value, 4 if kind == "ip" else 6)
    if kind == "email":
        at = value.rindex("@")
        host, _, top = value[at + 1 :].rpartition(".")
        return _permuted(secret, "email", f"{value[:at]}@{host}") + "." + top
    if kind == "phone":
        code = re.match(r"\+\d{1,3}(?=[ .-]|\()", value)
        cut = code.end() if code else 0
        return value[:cut] + _permuted(secret, "phone", value[cut:], digits_only=True)
    if kind == "ssn":
        return _permuted(secret, kind, value, digits_only=True)
    if kind == "card":
        return _card(secret, value)
    if kind == "iban":
        return _iban(secret, value)
    if kind.startswith("name"):
        return _name(secret, value)
    return _permuted(secret, kind, value, hexadecimal=bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)))


def redact_text(text: str, secret: bytes, originals: list[str] | None = None) -> tuple[str, list[dict]]:
    """The text with surrogates, and of each its type, its place in the new text and itself; originals takes their hashes."""
    parts, at, shift, found = [], 0, 0, []
    for a, b, kind in detect(text):
        new = surrogate(secret, kind, text[a:b])
        parts += [text[at:a], new]
        found.append({"type": kind, "start": a + shift, "end": a + shift + len(new), "surrogate": new})
        if originals is not None:
            plain = text[a:b]
            if kind in ("ip", "ip6"):  # 1.2.3.04 is 1.2.3.4, and 1:0::2 is 1::2
                plain = re.sub(r"\b0+(?=\d)", "", plain) if kind == "ip" else str(ipaddress.IPv6Address(plain))
                new = new.lower()
            originals.append(hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), key=hashlib.blake2b(secret, digest_size=32).digest(), digest_size=16).hexdigest())
        shift += len(new) - (b - a)
        at = b
    return ("".join([*parts, text[at:]]), found) if found else (text, found)


def _secret(documents: DataFrame, key: str | None) -> bytes:
    key = key or documents.sparkSession.conf.get("depthlane.pii.key", None)
    if not key:
        raise ValueError("surrogates need a secret: pass a key or set depthlane.pii.key")
    return key.encode()


ENTITIES = "array<struct<type: string, start: int, end: int, surrogate: string>>"
_PAIRS = pa.list_(pa.struct([("type", pa.string()), ("original", pa.string()), ("surrogate", pa.string())]))


def _redacted(text: str | None, secret: bytes) -> tuple[str | None, list[dict], list[dict]]:
    """The text with surrogates, its entities, and (type, original's hash, surrogate) of each."""
    if not isinstance(text, str):
        return None, [], []
    originals: list[str] = []
    new, found = redact_text(text, secret, originals)
    return new, found, [{"type": e["type"], "original": o, "surrogate": e["surrogate"]} for e, o in zip(found, originals, strict=True)]


def _checked(rows: DataFrame) -> DataFrame:
    """rows without _p_pairs, once their distinct pairs have shown no fault."""
    rows = materialise(rows, "pii")
    faults = collisions(rows.select(F.explode("_p_pairs").alias("p")).select("p.*")).groupBy("type", "fault").count().collect()
    if faults:
        raise ValueError(f"surrogates at fault: {sorted(tuple(f) for f in faults)}; choose another key")
    return rows.drop("_p_pairs")


def entities(documents: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text (with surrogates), n_entities, entities."""
    secret = _secret(documents, key)
    ship(documents.sparkSession)

    def run(frames):
        for frame in frames:
            done = [_redacted(t, secret) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": keys(frame["doc_id"]), "text": [t for t, _, _ in done], "n_entities": [len(e) for _, e, _ in done], "entities": [e for _, e, _ in done], "_p_pairs": [p for _, _, p in done]})

    pairs = "array<struct<type: string, original: string, surrogate: string>>"
    return _checked(source(documents).mapInPandas(run, f"doc_id long, text string, n_entities long, entities {ENTITIES}, _p_pairs {pairs}"))


def redact(documents: DataFrame, key: str | None = None) -> DataFrame:
    """All columns of documents, with surrogates in text and n_chars, where there is one, made to fit."""
    secret = _secret(documents, key)
    ship(documents.sparkSession)
    schema = documents.schema

    def run(batches):
        for batch in batches:
            done = [_redacted(t, secret) for t in batch["text"].to_pylist()]
            texts = pa.array([t for t, _, _ in done], batch.schema.field("text").type)
            columns = [texts if name == "text" else batch[name] for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([p for _, _, p in done], _PAIRS)], schema=batch.schema.append(pa.field("_p_pairs", _PAIRS)))

    out = documents.withColumn("_p_pairs", F.expr("cast(array() as array<struct<type: string, original: string, surrogate: string>>)"))
    out = _checked(documents.mapInArrow(run, out.schema)).select(*schema.names)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out


def collisions(pairs: DataFrame) -> DataFrame:
    """Of (type, original, surrogate): surrogates that stand for several originals, or originals with several surrogates."""
    plain = pairs.select("type", "original", "surrogate").distinct()
    several = plain.groupBy("type", "surrogate").agg(F.count("*").alias("n")).where("n > 1").select("type", F.col("surrogate").alias("value"), F.lit("shared").alias("fault"))
    split = plain.groupBy("type", "original").agg(F.count("*").alias("n")).where("n > 1").select("type", F.col("original").alias("value"), F.lit("split").alias("fault"))
    return several.unionByName(split)


__all__ = ["collisions", "detect", "entities", "redact", "redact_text", "surrogate"]
