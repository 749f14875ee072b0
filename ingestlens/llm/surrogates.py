"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

Everything is a column expression: a text is cut once by one pattern of all
entity kinds, written as mentions and what lies between them, and joined again
around the replaced mentions. What is replaced is a mention's *parts* (a person has given names and a
surname), each from a keyed hash of (type, canonical form): equal parts get
equal surrogates everywhere (coreference) without any lookup. The distinct
parts of the whole corpus are checked for two with one surrogate, and for
surrogates that are someone's real data; only parts that fail get a further
attempt, and only their mentions need a join. Surrogates grow longer at further
attempts, so a format of few values is never used up.
"""

from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ingestlens.llm.common import stored, table

#: For tests and demonstration; a real run passes a secret of its own.
DEFAULT_KEY = "not-a-secret"

#: The attempt from which on a surrogate gets one character more than its mention at each.
LONGER = 6
#: Stands around mentions while a text is cut; texts that have it themselves are cut by the pattern twice.
MARK = "\x01"
#: Added to the attempt of a given name after a neutral title whose gender is not the one its list tells.
OTHER_GENDER = 1000

MALE_TITLES = ["Mr", "Herr", "Señor", "Sr", "Monsieur", "господин", "г-н", "κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Srta", "Madame", "Mme", "Mlle", "госпожа", "г-жа", "κυρία"]
NEUTRAL_TITLES = ["Dr", "Prof", "Mx"]
#: Given names by gender and script, with syllables after them at further attempts; surnames are made of the syllables.
GIVEN = {
    ("m", "latin"): "Adam Albert Anton Bruno Carl Daniel David Edgar Erik Felix Frank Georg Henry Hugo Jakob Jonas Julian Karl Leon Louis Lucas Martin Max Nathan Oscar Paul Peter Simon Thomas Victor".split(),
    ("f", "latin"): "Ada Agnes Alice Anna Bella Clara Diana Edith Elena Emma Flora Greta Hanna Helena Ida Irene Julia Klara Laura Lena Lucia Maria Marta Nina Olga Paula Rosa Sara Sofia Vera".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Степан Фёдор".split(),
    ("f", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Раиса Софья".split(),
    ("m", "greek"): "Αντώνης Γιώργος Δημήτρης Ηλίας Θανάσης Κώστας Λευτέρης Μιχάλης Νίκος Πέτρος Σπύρος Στέλιος".split(),
    ("f", "greek"): "Αθηνά Βασιλική Δέσποινα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Ξένια Σοφία Φωτεινή Χριστίνα".split(),
}
SYLLABLES = {
    "latin": "bal ber bran cal cor dal den dor fal fen gar gol hal hen jar kel kor lan lin mar mel nor pal ram ren sal sol tan ter vel win".split(),
    "cyrillic": "бар вел гор дол жар зин кал лан мир нар пол рад сав тим фил хол чер шар".split(),
    "greek": "βαλ γορ δαμ ζαν θεν καλ λαν μαρ νικ παλ ραν σολ ταν φιλ χαρ".split(),
}
#: Letters of other scripts that stand for letters of theirs; a letter of any further script becomes one of a-z.
LETTERS = {
    "Cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ",
    "Hebrew": "אבגדהוזחטילמנסעפצקרשת",
    "Arabic": "بتثجحدرزسشصطعفقكلمنهوي",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "Han": "一丁七万三上下中人今他代休作来光入八六共分力十千口古同名四国土大天女子学小山川工年心手文方日月木本東林水火田白目石空立竹糸耳花見車金雨青音",
    "Hangul": "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허고노도로모보소오조초코토포호",
    "Devanagari": "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह",
    "Thai": "กขคงจฉชซญดตถทธนบปผฝพฟภมยรลวสหอ",
}

def _alphabets() -> list[str]:
    """The capitals of every script: today's Latin, accented Latin and today's Russian by themselves, scripts of few capitals together."""
    found = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŁŠŽ", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
    taken, scripts = set("".join(found)), {}
    for c in map(chr, range(0x80, 0x1F000)):
        if unicodedata.category(c) == "Lu" and c not in taken:
            scripts.setdefault(unicodedata.name(c).split()[0], []).append(c)
    rest = "".join(c for letters in scripts.values() if len(letters) < 10 for c in letters)
    return [*found, *("".join(letters) for letters in scripts.values() if len(letters) >= 10), rest]


#: Initials are turned within these, so that distinct ones stay distinct.
ALPHABETS = _alphabets()
FEMALE_NAMES = [n.lower() for (gender, _), names in GIVEN.items() if gender == "f" for n in names]
#: Titles in other cases; those that are common words or units in them need their full stop.
CASED_TITLES = "MR MRS DR PROF HERR FRAU MONSIEUR MADAME SEÑOR SEÑORA mr mrs dr prof".split()
_TITLES = "|".join([*MALE_TITLES, *FEMALE_TITLES, *NEUTRAL_TITLES, *CASED_TITLES, r"MS(?=\.)", r"ms(?=\.)"])
#: Words that end a name although they have a capital, or stand where a name in small letters would.
_STOP = (
    "a|an|the|and|but|or|nor|if|in|on|at|by|for|from|to|with|without|of|into|over|under|as|than|so|not|no|yes|he|she|it|they|we|you|his|her|their|our|my|"
    "this|that|these|those|there|here|then|when|while|after|before|since|until|who|whom|which|what|where|why|how|is|was|are|were|be|been|has|have|had|do|does|did|"
    "will|would|can|could|should|must|said|says|told|asked|went|came|left|got|took|made|gave|also|only|just|today|yesterday|tomorrow|"
    "monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|july|september|october|november|december"
)
_JOINED = r"(?:['’](?![sS](?!\p{L}))|-)\p{L}++"
#: A word with a capital; a possessive ``'s``, a closing quote or a dash at its end is none of it.
_WORD = rf"\p{{Lu}}(?:\p{{L}}++(?:{_JOINED}){{0,8}}+|(?:{_JOINED}){{1,8}}+)"
_NAME = rf"(?!(?:{_TITLES})(?!\p{{L}})){_WORD}"
_LATER = rf"(?!(?i:{_STOP})(?!\p{{L}})){_NAME}"
_SMALL = rf"(?!(?:{_STOP})(?!\p{{L}}))\p{{Ll}}\p{{L}}++(?:{_JOINED}){{0,8}}+"
_INITIAL = r"(?:\p{Lu}\.)+|\p{Lu}(?= )"
#: Words inside names that stay as they are.
_PARTICLE = "von|van|vom|der|den|de|del|della|di|da|dos|du|la|las|le|los|ter|ten|af|av|bin|ibn|al|el|y"
_BETWEEN = rf"(?:(?:{_INITIAL}|{_PARTICLE}) ){{0,8}}"
_SECRET = r"(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}+",
    "secret": rf"(?<![A-Za-z]){_SECRET}(?:[^\s\"',;]{{8,}}+|(?=[^\s\"',;]{{0,6}}\d)[^\s\"',;]{{4,7}}+)",
    "pem": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]{0,20}PRIVATE KEY-----",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,40}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "person": rf"(?<![\p{{L}}])(?:{_TITLES})\.? (?:{_BETWEEN}{_NAME}(?: {_BETWEEN}{_LATER}){{0,15}}|(?:\p{{Lu}}\.)+(?!\p{{L}}))"
    rf"|(?<![\p{{L}}])(?:mr|mrs|ms|dr|prof)\. {_SMALL}(?: {_SMALL})?",
}
ENTITY = "|".join(PATTERNS.values())
#: No text without a digit, an ``@`` or one of these has an entity; the first list in any case.
HINT_WORDS = "password passwd pwd passphrase secret token key".split()
HINT_PARTS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "eyJ", "PRIVATE KEY", *sorted({*MALE_TITLES, *FEMALE_TITLES, *NEUTRAL_TITLES} - {"Mrs", "Sra", "Srta"})]


def may_have(text: Column) -> Column:
    """Whether an entity is possible at all: plain searches, far cheaper than the pattern, that pass every text it matches."""
    lower = F.lower(text)
    found = text.rlike(r"[0-9@]|(?<!\p{L})(?:mr|mrs|dr|prof|MR|MRS|DR|PROF|HERR|FRAU|MONSIEUR|MADAME|SEÑORA?|M[sS](?=\.)|ms(?=\.))[. ]")
    for word in HINT_WORDS:
        found = found | F.contains(lower, F.lit(word))
    for part in HINT_PARTS:
        found = found | F.contains(text, F.lit(part))
    return found


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once; without it every mention of it would be a copy of its tree."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""

    def add(total: Column, c: Column, i: Column) -> Column:
        d = c.cast("int")
        return total + F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    numbered = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), lambda t, x: add(t, x["c"], x["i"])) % 10


def kind_of(m: Column) -> Column:
    """The kind of a mention that ``ENTITY`` matched; null for what is none after all (a failed checksum, a secret of stars)."""
    return (
        F.when(m.rlike(rf"^{_SECRET}"), F.when(F.regexp_replace(m, rf"^{_SECRET}", "").rlike(r"[\p{L}\p{N}]"), F.lit("secret")))
        .when(m.startswith("-----BEGIN"), F.lit("pem"))
        .when(m.contains("@"), F.lit("email"))
        .when(m.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|sk-)[A-Za-z0-9]+$|^eyJ[\w-]+\.[\w-]+\.[\w-]+$"), F.lit("key"))
        .when(m.rlike("^[0-9A-Fa-f:]+:[0-9A-Fa-f:]+$"), F.lit("ip6"))
        .when(m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), F.lit("ip"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.lit("ssn"))
        .when(m.rlike(r"^[+(]|^\d{3}[ .-]\d{3}[ .-]\d{4}$"), F.lit("phone"))
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), F.when(_iban_rest(F.regexp_replace(m, " ", "")) == 1, F.lit("iban")))
        .when(m.rlike(r"^\d"), F.when(_luhn(_digits(m)) == 0, F.lit("card")))
        .otherwise(F.lit("person"))
    )


def _iban_rest(v: Column) -> Column:
    def add(r: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return (r * F.when(digit, 10).otherwise(100) + F.ascii(c) - F.when(digit, 48).otherwise(55)) % 97

    return F.aggregate(F.split(F.concat(F.substring(v, 5, 64), F.substring(v, 1, 4)), ""), F.lit(0), add)


def _title(m: Column) -> Column:
    """A person's title with its space."""
    return F.regexp_extract(m, rf"^((?:{_TITLES})\.? )", 1)


def _names(m: Column) -> Column:
    """A person's name words, the surname last."""
    return F.split(F.regexp_replace(m, rf"^(?:{_TITLES})\.? ", ""), " ")


def _has_title(m: Column, titles: list[str]) -> Column:
    return F.lower(F.regexp_replace(_title(m), r"\.? $", "")).isin([t.lower() for t in titles])


def _plain(w: Column) -> Column:
    """A name word in small letters, with one form of apostrophe."""
    return F.translate(F.lower(w), "’", "'")


def _national(m: Column) -> Column:
    """The digits of a phone number, without a ``+1`` before ten others."""
    return F.when(m.startswith("+"), F.regexp_replace(_digits(m), r"^1(?=\d{10}$)", "")).otherwise(_digits(m))


def parts_of(m: Column, kind: Column) -> Column:
    """array<struct<type, canon>> of a mention: what must get the same surrogate wherever it stands."""
    part = lambda t, c: F.struct(t.alias("type"), c.alias("canon"))

    def person() -> Column:
        female = lambda w: _has_title(m, FEMALE_TITLES) | _has_title(m, NEUTRAL_TITLES) & F.lower(w).isin(FEMALE_NAMES)

        def one(w: Column, i: Column, n: Column) -> Column:
            return (
                F.when(w.rlike(r"^(?:\p{Lu}\.)+$|^\p{Lu}$"), part(F.lit("initial"), w))
                .when(w.rlike(rf"^(?:{_PARTICLE})$"), part(F.lit("particle"), w))
                .when(i == n - 1, part(F.lit("surname"), _plain(w)))
                .otherwise(part(F.when(female(w), "given_f").otherwise("given_m"), _plain(w)))
            )

        return _let(_names(m), lambda names: F.transform(names, lambda w, i: one(w, i, F.size(names))))

    canon = (
        F.when(kind.isin("email", "ip6"), F.lower(m))
        .when(kind == "phone", _national(m))
        .when(kind.isin("card", "ssn"), _digits(m))
        .when(kind == "secret", F.regexp_replace(m, rf"^{_SECRET}", ""))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .otherwise(m)
    )
    return F.when(kind == "person", person()).otherwise(F.array(part(kind, canon)))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """64 keyed bytes as hex."""
    seed = lambda n: F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"), F.lit(n))
    return F.concat(F.sha2(seed("0"), 256), F.sha2(seed("1"), 256))


def _letter(c: Column, b: Column) -> Column:
    """A letter of the script and case of ``c``, which is none of a-z."""
    chosen = F.char(b % 26 + 97)
    for script, letters in LETTERS.items():
        chosen = F.when(c.rlike(rf"\p{{Is{script}}}"), F.substr(F.lit(letters), b % len(letters) + 1, F.lit(1))).otherwise(chosen)
    return F.when(c.rlike(r"\p{Lu}"), F.upper(chosen)).otherwise(chosen)


def _same_classes(canon: Column, stream: Column, keep: Column | int = 0) -> Column:
    """Digits for digits, letters for letters of the same script and case (hex for all-hex values); the first ``keep`` characters stay."""
    kept = F.lit(keep) if isinstance(keep, int) else keep

    def one(c: Column, i: Column, letters: Column) -> Column:
        return (
            F.when(i < kept, c)
            .when(c.rlike("[0-9]"), (_byte(stream, i) % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(_byte(stream, i) % letters + 97))
            .when(c.rlike("[A-Z]"), F.char(_byte(stream, i) % letters + 65))
            .when(c.rlike(r"\p{L}"), _letter(c, _byte(stream, i)))
            .when(c.rlike(r"\p{N}"), (_byte(stream, i) % 10).cast("string"))
            .otherwise(c)
        )

    return _let(
        F.when(canon.rlike("^(?:[0-9a-f:]+|[0-9A-F]+)$"), 6).otherwise(26),
        lambda letters: F.array_join(F.transform(F.split(canon, ""), lambda c, i: one(c, i, letters)), ""),
    )


def _pick(words: list[str], b: Column) -> Column:
    """One of ``words``, given to Spark as one literal that it splits once."""
    return F.element_at(F.split(F.lit(" ".join(words)), " "), b % len(words) + 1)


def surrogate_of(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical surrogate of a part."""
    return _let(canon, lambda c: _let(_stream(key, kind, c, attempt), lambda s: _surrogate(key, kind, c, s, attempt)))


def _initials(key: str, c: Column) -> Column:
    """Every initial as another one: alphabets turned by a keyed step, so that distinct ones stay distinct."""
    turned = []
    for a in ALPHABETS:
        step = int(hashlib.sha256(f"{key}|initial|{a}".encode()).hexdigest(), 16) % (len(a) - 1) + 1
        turned.append(a[step:] + a[:step])
    return F.translate(c, "".join(ALPHABETS), "".join(turned))


def _further_script(canon: Column) -> Column:
    """Whether a name has letters of a script without name lists; they are replaced one by one, in their script."""
    return canon.rlike(r"(?![\p{IsLatin}\p{IsCyrillic}\p{IsGreek}])\p{L}")


def _surrogate(key: str, kind: Column, canon: Column, s: Column, attempt: Column) -> Column:
    # The part of the value that is replaced character by character, and how many of its first characters stay.
    header = F.regexp_extract(canon, "^(-----BEGIN [A-Z ]+-----)", 1)
    footer = F.regexp_extract(canon, "(-----END [A-Z ]+-----)$", 1)
    inner = F.substr(canon, F.length(header) + 1, F.length(canon) - F.length(header) - F.length(footer))
    changed = (
        F.when(kind == "email", F.substring_index(canon, "@", 1))
        .when(kind == "card", F.substr(canon, F.lit(1), F.length(canon) - 1))
        .when(kind == "pem", inner)
        .otherwise(canon)
    )
    keep = F.when(kind == "card", 1).when(kind.isin("iban", "key"), 4).when(kind == "phone", F.length(canon) - 10).otherwise(0)
    alike = F.when(~kind.isin("given_m", "given_f", "surname", "ip") | kind.isin("given_m", "given_f", "surname") & _further_script(canon), _same_classes(changed, s, keep))
    return _let(alike, lambda x: _assembled(key, kind, canon, s, attempt, x, header, footer))


def _assembled(key: str, kind: Column, canon: Column, s: Column, attempt: Column, alike: Column, header: Column, footer: Column) -> Column:
    at = lambda i: _byte(s, F.lit(i))
    longer = F.when(attempt >= LONGER, F.substr(s, F.lit(97), attempt - (LONGER - 1))).otherwise("")
    digits = F.translate(longer, "abcdef", "012345")

    def email(domain: Column) -> Column:
        tld = F.substring_index(domain, ".", -1)
        return F.concat(
            alike,
            longer,
            F.lit("@"),
            _same_classes(F.substring_index(domain, ".", 1), _stream(key, F.lit("domain"), domain, F.lit(0))),
            F.lit(".example."),
            F.when(tld.isin("com", "org", "net"), tld).otherwise("com"),
        )

    octet = lambda i, most: ((at(i) * 256 + at(i + 8)) % most + 1).cast("string")
    card = _let(F.concat(alike, digits), lambda x: F.concat(x, ((F.lit(10) - _luhn(F.concat(x, F.lit("0")))) % 10).cast("string")))
    country = F.substring(canon, 1, 2)
    iban = _let(
        F.concat(F.substring(alike, 5, 64), digits),
        lambda x: F.concat(country, F.lpad((98 - _iban_rest(F.concat(country, F.lit("00"), x))).cast("string"), 2, "0"), x),
    )
    # Addresses kept for documents, with 96 keyed bits; where IPv4 ones are used up.
    documented = F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(s, 1 + 4 * i, 4)) for i in range(6)])
    by_script = lambda make: F.when(canon.rlike(r"\p{IsCyrillic}"), make("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), make("greek")).otherwise(make("latin"))
    more = lambda script, n: F.when(attempt >= n, _pick(SYLLABLES[script], at(n) * 5 + at(n + 9))).otherwise("")
    named = lambda g, script: F.concat(_pick(GIVEN[g, script], at(0) * 7 + at(1)), *[more(script, n) for n in range(1, 9)])
    given = lambda g: by_script(lambda script: named(g, script))
    made = lambda script: F.initcap(F.concat(*[_pick(SYLLABLES[script], at(i + 20) * 5 + at(i + 29)) for i in range(4)], *[more(script, n) for n in range(1, 9)]))
    return (
        F.when(kind == "email", _let(F.substring_index(canon, "@", -1), email))
        .when(kind.isin("ip", "ip6") & (attempt >= LONGER), documented)
        .when(kind == "ip", F.concat_ws(".", octet(0, 223), octet(1, 254), octet(2, 254), octet(3, 254)))
        .when(kind == "ip6", alike)
        .when(kind == "pem", F.concat(header, alike, longer, footer))
        .when(kind == "card", card)
        .when(kind == "phone", F.concat(alike, digits))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(alike, 2, 8), digits))
        .when(kind == "iban", iban)
        .when(kind.isin("given_m", "given_f", "surname") & _further_script(canon), F.initcap(F.concat(alike, longer)))
        .when(kind == "given_m", given("m"))
        .when(kind == "given_f", given("f"))
        .when(kind == "initial", _initials(key, canon))
        .when(kind == "particle", canon)
        .when(kind == "surname", by_script(made))
        .otherwise(F.concat(alike, longer))
    )


def _like(model: Column, value: Column) -> Column:
    """``value`` in capitals or in small letters if the mention is."""
    has_case = F.lower(model) != F.upper(model)
    capitals = (F.length(model) > 1) & (model == F.upper(model)) & has_case
    return F.when(capitals, F.upper(value)).when((model == F.lower(model)) & has_case, F.lower(value)).otherwise(value)


def _cased(model: Column, value: Column) -> Column:
    """``value`` with capitals at the places where the mention has them."""
    capital = lambda i: F.substr(model, i + 1, F.lit(1)).rlike("[A-Z]")
    placed = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(capital(i), F.upper(c)).otherwise(c)), "")
    return F.when(model.rlike("[A-Z]"), F.when(model == F.upper(model), F.upper(value)).otherwise(placed)).otherwise(value)


def _other(kind: Column) -> Column:
    """The type of a given name of the other gender."""
    return F.when(kind == "given_m", "given_f").otherwise("given_m")


def replacement(key: str, m: Column, attempts: Column) -> Column:
    """A mention's replacement in the mention's format; ``attempts``: a number per part, 0 where missing."""

    def one(p: Column, i: Column) -> Column:
        attempt = F.coalesce(F.get(attempts, i), F.lit(0))
        kind = F.when(attempt >= OTHER_GENDER, _other(p["type"])).otherwise(p["type"])
        return surrogate_of(key, kind, p["canon"], attempt % OTHER_GENDER)

    made = lambda kind: F.transform(parts_of(m, kind), one)
    return _let(kind_of(m), lambda kind: F.when(kind.isNull(), m).otherwise(_let(made(kind), lambda parts: _formatted(m, kind, parts))))


def _formatted(m: Column, kind: Column, parts: Column) -> Column:
    first = F.get(parts, F.lit(0))
    names = F.transform(_names(m), lambda w, i: _like(w, F.get(parts, i)))
    person = F.concat(_title(m), F.array_join(names, " "))
    # The country's digit, which is no part of the surrogate of a number given with ``+1`` or without.
    whole = F.when((kind == "phone") & (_national(m) != _digits(m)), F.concat(F.lit("1"), first)).otherwise(first)
    before = lambda i: F.length(_digits(F.substr(m, F.lit(1), i)))
    in_format = F.array_join(
        F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(whole, before(i) + 1, F.lit(1))).otherwise(c)), ""
    )
    return (
        F.when(kind == "person", person)
        .when(kind.isin("phone", "card", "ssn"), F.concat(in_format, F.substr(whole, F.length(_digits(m)) + 1, F.length(whole))))
        .when(kind == "secret", F.concat(F.regexp_extract(m, rf"^({_SECRET})", 1), first))
        .when(kind == "iban", F.when(m.contains(" "), F.regexp_replace(first, "(.{4})(?=.)", "$1 ")).otherwise(first))
        .when(kind.isin("email", "ip6"), _cased(m, first))
        .otherwise(first)
    )


def retries(parts: DataFrame, key: str) -> DataFrame:
    """The (type, canon) of ``parts`` that need an attempt other than 0, so that all surrogates are distinct.

    Of two parts of one type with one surrogate the first keeps it; a surrogate
    that is real data of its type elsewhere in the corpus is refused too. Given
    names of both genders count as one type here. As surrogates grow at further
    attempts, the number of rounds is that of a few collisions in a row.
    """
    surrogate = surrogate_of(key, F.col("type"), F.col("canon"), F.col("attempt"))
    parts = stored(parts.withColumn("space", F.when(F.col("type").startswith("given_"), "given").otherwise(F.col("type"))), "parts")
    real = parts.select("space", F.col("canon").alias("surrogate")).distinct()
    now = parts.withColumn("attempt", F.lit(0))
    while True:
        now = stored(now.withColumn("surrogate", F.when(F.col("space").isin("surname", "given"), F.lower(surrogate)).otherwise(surrogate)), "surrogates")
        order = W.partitionBy("space", "surrogate").orderBy("attempt", "canon", "type")
        taken = now.join(real, ["space", "surrogate"], "left_semi").select("type", "canon").withColumn("bad", F.lit(True))
        again = now.withColumn("nth", F.row_number().over(order)).join(taken, ["type", "canon"], "left")
        again = stored(again.withColumn("redo", (F.col("nth") > 1) | F.coalesce("bad", F.lit(False))), "judged")
        if again.filter("redo").isEmpty():
            return now.filter("attempt > 0").select("type", "canon", "attempt")
        now = again.select("type", "canon", "space", (F.col("attempt") + F.col("redo").cast("int")).alias("attempt"))


def _genders(by_mention: DataFrame) -> DataFrame:
    """``m, i, other`` of given names after neutral titles whose gender other mentions tell: of the same full name, else of the given name."""
    neutral = _has_title(F.col("m"), NEUTRAL_TITLES)
    each = by_mention.filter(F.col("kind") == "person").select(
        "m", neutral.alias("neutral"), F.transform("parts", lambda p: p["canon"]).alias("name"), F.posexplode("parts").alias("i", "p")
    )
    each = each.select("m", "neutral", "name", "i", "p.type", "p.canon").filter(F.col("type").startswith("given_"))

    def told(by: str, name: str) -> DataFrame:
        seen = each.filter(~F.col("neutral")).groupBy(by).agg(F.min("type").alias(name), F.max("type").alias("most"))
        return seen.filter(F.col(name) == F.col("most")).drop("most")

    known = each.filter("neutral").join(told("name", "of_name"), "name", "left").join(told("canon", "of_given"), "canon", "left")
    return known.select("m", "i", (F.coalesce("of_name", "of_given", "type") != F.col("type")).alias("other")).filter("other")


def cut_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``__mentions`` and the ``__pieces`` around them, in place of the text where there are any; each with a number ``__row``."""
    text = F.col(text_col)
    marked = F.when(
        may_have(text) & ~F.contains(text, F.lit(MARK)), F.split(F.regexp_replace(text, ENTITY, f"{MARK}$0{MARK}"), MARK, -1)
    )
    both = docs.withColumn("__cut", marked)
    twice = may_have(text) & F.contains(text, F.lit(MARK))
    mentions = F.when(twice, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.filter("__cut", lambda _, i: i % 2 == 1))
    pieces = F.when(twice, F.split(text, ENTITY, -1)).otherwise(F.filter("__cut", lambda _, i: i % 2 == 0))
    both = both.withColumn("__mentions", F.coalesce(mentions, F.array().cast("array<string>"))).withColumn("__pieces", pieces)
    has = F.size("__mentions") > 0
    return both.select(
        *[F.when(~has, text).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(has, F.col("__pieces")).alias("__pieces"),
        "__mentions",
        F.monotonically_increasing_id().alias("__row"),
    )


def known_names(mentions: Column, new: Column) -> Column:
    """map of a text's name words, in small letters, to their surrogates, from its titled mentions and their replacements."""

    def words(m: Column, r: Column) -> Column:
        both = F.zip_with(_names(m), _names(r), lambda a, b: F.struct(_plain(a).alias("word"), F.initcap(F.lower(b)).alias("new"), a.alias("as_is")))
        return F.filter(both, lambda x: x["as_is"].rlike(rf"^{_WORD}$|^{_SMALL}$") & ~x["as_is"].rlike(f"^(?:{_PARTICLE})$"))

    none = F.array().cast("array<struct<word:string,new:string,as_is:string>>")
    titled = F.zip_with(mentions, new, lambda m, r: F.when(m.rlike(rf"^(?:{_TITLES})\.? "), words(m, r)).otherwise(none))
    entries = F.array_sort(F.array_distinct(F.transform(F.flatten(titled), lambda x: F.struct(x["word"].alias("word"), x["new"].alias("new")))))
    # A word that is a given name of one and the surname of another is taken as the first in order.
    firsts = _let(entries, lambda e: F.filter(e, lambda x, i: (i == 0) | (F.get(e, i - 1)["word"] != x["word"])))
    return F.map_from_entries(firsts)


def _with_bare_names(piece: Column, known: Column) -> Column:
    """What lies between mentions, with the capitalised words that ``known`` has replaced."""
    word = rf"(?<!\p{{L}}){_WORD}"
    named = lambda w: F.coalesce(_like(w, F.try_element_at(known, _plain(w))), w)
    cut = lambda words: F.transform(F.split(piece, word, -1), lambda gap, i: F.concat(gap, F.coalesce(named(F.get(words, i)), F.lit(""))))
    return F.array_join(_let(F.regexp_extract_all(piece, F.lit(word), F.lit(0)), cut), "")


def replace_entities(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text's entities replaced, plus ``n_entities`` and ``entity_kinds``.

    Null texts stay null with no entities; texts without entities stay as they
    are, byte for byte; repeated rows get equal results; an empty table gives
    an empty one; a very long text is one task's work. Name words of a titled
    person are replaced wherever the same text has them with a capital; these
    bare mentions are not counted. ``entity_kinds`` lists the sorted distinct
    kinds, comma-joined. Columns with the result's names are replaced.
    """
    base = docs.drop("n_entities", "entity_kinds")
    found = stored(cut_texts(base, text_col), "cut-texts")
    seen = found.select(F.explode("__mentions").alias("m")).distinct()
    kinds = seen.withColumn("kind", kind_of(F.col("m"))).filter("kind is not null")
    by_mention = stored(kinds.select("m", "kind", parts_of(F.col("m"), F.col("kind")).alias("parts")), "mentions")
    nth = by_mention.select("m", F.posexplode("parts").alias("i", "p")).select("m", "i", "p.type", "p.canon").join(_genders(by_mention), ["m", "i"], "left")
    nth = nth.withColumn("type", F.when(F.col("other"), _other(F.col("type"))).otherwise(F.col("type")))
    odd = retries(nth.filter(~F.col("type").isin("initial", "particle")).select("type", "canon").distinct(), key)
    none = F.array().cast("array<int>")
    number = F.coalesce("attempt", F.lit(0)) + F.when(F.col("other"), OTHER_GENDER).otherwise(0)
    nth = nth.join(odd, ["type", "canon"], "left").select("m", "i", number.alias("attempt"))
    tries = F.transform(F.sort_array(F.collect_list(F.struct("i", F.col("attempt").alias("a")))), lambda x: x["a"])
    per_mention = nth.groupBy("m").agg(tries.alias("tries")).filter(F.exists("tries", lambda a: a > 0))
    # Rows with a mention that needs another attempt meet its numbers; those without mentions take no part in this join.
    has = F.size("__mentions") > 0
    told = found.select("__row", F.posexplode("__mentions").alias("at", "m")).join(per_mention, "m")
    told = stored(told.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("at", "tries"))).alias("__told")), "attempts")
    done = found.filter(has).join(told, "__row", "left")
    attempt = lambda i: F.coalesce(F.try_element_at("__told", i), none)
    replaced = done.withColumn("__new", F.transform("__mentions", lambda m, i: replacement(key, m, attempt(i))))
    # Who has a title once is known in the whole text: names without one follow.
    replaced = replaced.withColumn("__known", known_names(F.col("__mentions"), F.col("__new")))
    follow = F.transform("__pieces", lambda p: _with_bare_names(p, F.col("__known")))
    replaced = replaced.withColumn("__pieces", F.when(F.size("__known") > 0, follow).otherwise(F.col("__pieces")))
    joined = F.array_join(F.transform("__pieces", lambda p, i: F.concat(p, F.coalesce(F.get("__new", i), F.lit("")))), "")
    kinds_of = F.filter(F.transform("__mentions", kind_of), lambda k: k.isNotNull())
    changed = replaced.select(
        *[joined.alias(c) if c == text_col else F.col(c) for c in base.columns],
        F.size(kinds_of).cast("long").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct(kinds_of)), ",").alias("entity_kinds"),
    )
    return changed.unionByName(found.filter(~has).select(*base.columns, F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entity_kinds")))


def op2_surrogates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs).select("doc_id", "n_entities", "entity_kinds", "text")
