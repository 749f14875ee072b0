"""Surrogates once more in plain Python, mention by mention, for comparison."""

import hashlib

import regex

from ingestlens.llm import surrogates as S


def ascii_classes(pattern):
    """The pattern with ``\\d \\w \\s \\D`` as ASCII sets, which is how the JVM reads them."""
    sets, out, inside, i = {"d": "0-9", "w": "A-Za-z0-9_", "s": " \\t\\n\\x0b\\f\\r"}, [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = pattern[i + 1]
            out.append((sets[n] if inside else f"[{sets[n]}]") if n in sets else "[^0-9]" if n == "D" else c + n)
            i += 2
            continue
        inside = (inside or c == "[") and c != "]"
        out.append(c)
        i += 1
    return "".join(out)


find = lambda p: regex.compile(ascii_classes(p))
ENTITY, SECRET, TITLE = find(S.ENTITY), find(rf"^{S._SECRET}"), find(rf"^(?:{S._TITLES})\.? ")
OCTETS = find(rf"^{S._OCTET}(?:\.{S._OCTET}){{3}}$")
BARE = find(rf"(?<!\p{{L}}){S._WORD}")
plain = lambda w: w.lower().replace("’", "'")
national = lambda m: regex.sub("^1(?=[0-9]{10}$)", "", digits(m)) if m[0] == "+" else digits(m)
further = lambda c: regex.search(r"(?![\p{IsLatin}\p{IsCyrillic}\p{IsGreek}])\p{L}", c)
initcap = lambda t: t[:1].upper() + t[1:].lower()
digits = lambda t: regex.sub("[^0-9]", "", t)
luhn = lambda t: sum(int(d) * (i % 2 + 1) - 9 * (i % 2 and int(d) > 4) for i, d in enumerate(reversed(t))) % 10
iban_rest = lambda v: int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97


def kind_of(m):
    if SECRET.search(m):
        return "secret" if regex.search(r"[\p{L}\p{N}]", SECRET.sub("", m)) else None
    if m.startswith("-----BEGIN"):
        return "pem"
    if "@" in m:
        return "email"
    if regex.fullmatch(r"(?:AKIA|ASIA|gh[pousr]_|sk-)[A-Za-z0-9]+|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", m):
        return "key"
    if regex.fullmatch("[0-9A-Fa-f:]+", m) and ":" in m:
        return "ip6"
    if OCTETS.search(m):
        return "ip"
    if regex.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        return "ssn"
    if m[0] in "+(" or regex.fullmatch("[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}", m):
        return "phone"
    if regex.match("[A-Z]{2}[0-9]{2}", m):
        return "iban" if iban_rest(m.replace(" ", "")) == 1 else None
    if m[0].isdigit():
        return "card" if luhn(digits(m)) == 0 else None
    return "person"


def title_of(m):
    return regex.sub(r"\.? $", "", TITLE.search(m)[0])


def parts_of(m, kind):
    """[type, canon] of every part."""
    if kind != "person":
        canon = {"email": m.lower(), "ip6": m.lower(), "phone": national(m), "card": digits(m), "ssn": digits(m), "secret": SECRET.sub("", m), "iban": m.replace(" ", "")}
        return [(kind, canon.get(kind, m))]
    names, out, title = TITLE.sub("", m).split(" "), [], title_of(m)
    for i, w in enumerate(names):
        of = lambda titles: title.lower() in [t.lower() for t in titles]
        female = of(S.FEMALE_TITLES) or of(S.NEUTRAL_TITLES) and w.lower() in S.FEMALE_NAMES
        if regex.fullmatch(r"(?:\p{Lu}\.)+|\p{Lu}", w):
            out.append(("initial", w))
        elif regex.fullmatch(S._PARTICLE, w):
            out.append(("particle", w))
        else:
            out.append(("surname" if i == len(names) - 1 else "given_f" if female else "given_m", plain(w)))
    return out


def same_classes(canon, b, keep):
    span, out = 6 if regex.fullmatch("[0-9a-f:]+|[0-9A-F]+", canon) else 26, []
    for i, c in enumerate(canon):
        x = b(i)
        if i < keep:
            out.append(c)
        elif "0" <= c <= "9":
            out.append(str(x % 10))
        elif "a" <= c <= "z" or "A" <= c <= "Z":
            out.append(chr(x % span + (97 if c.islower() else 65)))
        elif regex.match(r"\p{L}", c):
            letter = next((t[x % len(t)] for s, t in S.LETTERS.items() if regex.match(rf"\p{{Is{s}}}", c)), chr(x % 26 + 97))
            out.append(letter.upper() if regex.match(r"\p{Lu}", c) else letter)
        else:
            out.append(str(x % 10) if regex.match(r"\p{N}", c) else c)
    return "".join(out)


def surrogate(key, kind, canon, attempt):
    def stream(kind, canon, attempt):
        s = "".join(hashlib.sha256(f"{key}|{kind}|{canon}|{attempt}|{n}".encode()).hexdigest() for n in (0, 1))
        return s, lambda i: int(s[i % 64 * 2 : i % 64 * 2 + 2], 16)

    s, b = stream(kind, canon, attempt)
    longer = s[96 : 96 + max(0, attempt - S.LONGER + 1)]
    more = longer.translate(str.maketrans("abcdef", "012345"))
    alike = lambda t, keep=0: same_classes(t, b, keep)
    script = "cyrillic" if regex.search(r"\p{IsCyrillic}", canon) else "greek" if regex.search(r"\p{IsGreek}", canon) else "latin"
    pick = lambda t, n: t[n % len(t)]
    syllable = lambda i, j: pick(S.SYLLABLES[script], b(i) * 5 + b(j))
    extra = "".join(syllable(n, n + 9) for n in range(1, 9) if attempt >= n)
    if kind == "email":
        domain = canon.rsplit("@", 1)[1]
        tld = domain.rsplit(".", 1)[1]
        host = same_classes(domain.split(".")[0], stream("domain", domain, 0)[1], 0)
        return f"{alike(canon.split('@')[0])}{longer}@{host}.example.{tld if tld in ('com', 'org', 'net') else 'com'}"
    if kind in ("ip", "ip6") and attempt >= S.LONGER:
        return "2001:db8" + "".join(f":{s[4 * i : 4 * i + 4]}" for i in range(6))
    if kind == "ip":
        return ".".join(str((b(i) * 256 + b(i + 8)) % most + 1) for i, most in enumerate((223, 254, 254, 254)))
    if kind == "ip6":
        return alike(canon)
    if kind == "pem":
        head, inner, foot = regex.fullmatch("(-----BEGIN [A-Z ]+-----)(.*)(-----END [A-Z ]+-----)", canon, regex.S).groups()
        return head + alike(inner) + longer + foot
    if kind == "card":
        x = alike(canon[:-1], 1) + more
        return x + str((10 - luhn(x + "0")) % 10)
    if kind == "phone":
        return alike(canon, len(canon) - 10) + more
    if kind == "ssn":
        return "9" + alike(canon)[1:] + more
    if kind == "iban":
        x = alike(canon, 4)[4:] + more
        return f"{canon[:2]}{98 - iban_rest(canon[:2] + '00' + x):02d}{x}"
    if kind in ("given_m", "given_f", "surname") and further(canon):
        return initcap(alike(canon) + longer)
    if kind in ("given_m", "given_f"):
        return pick(S.GIVEN[kind[-1], script], b(0) * 7 + b(1)) + extra
    if kind == "initial":
        for a in S.ALPHABETS:
            step = int(hashlib.sha256(f"{key}|initial|{a}".encode()).hexdigest(), 16) % (len(a) - 1) + 1
            canon = "".join(("\0" + a[(a.index(c) + step) % len(a)]) if c in a and canon[i - 1 : i] != "\0" else c for i, c in enumerate(canon))
        return "".join("" if c == "\0" else c for c in canon)
    if kind == "particle":
        return canon
    if kind == "surname":
        return ("".join(syllable(i + 20, i + 29) for i in range(4)) + extra).capitalize()
    return alike(canon, 4 if kind == "key" else 0) + longer


def replaced(rows, key=S.DEFAULT_KEY):
    """The text of every (id, text) with its entities replaced."""
    mentions = {m for _, t in rows for m in ENTITY.findall(t or "")}
    kinds = {m: kind_of(m) for m in mentions}
    parts = {m: parts_of(m, k) for m, k in kinds.items() if k}
    given = [(m, i, tuple(c for _, c in p), t, c) for m, p in parts.items() if kinds[m] == "person" for i, (t, c) in enumerate(p) if t.startswith("given")]
    told = {}
    for m, _, name, t, c in given:
        if title_of(m).lower() not in [x.lower() for x in S.NEUTRAL_TITLES]:
            told.setdefault(name, set()).add(t)
            told.setdefault(c, set()).add(t)
    for m, i, name, t, c in given:
        if title_of(m).lower() in [x.lower() for x in S.NEUTRAL_TITLES]:
            known = next((next(iter(told[x])) for x in (name, c) if len(told.get(x, ())) == 1), t)
            parts[m][i] = (known, c)
    space = lambda t: "given" if t.startswith("given") else t
    attempts = {p: 0 for ps in parts.values() for p in ps if p[0] not in ("initial", "particle")}
    real = {(space(t), c) for t, c in attempts}
    while True:
        made = {p: surrogate(key, *p, a) for p, a in attempts.items()}
        taken, redo = set(), []
        for p in sorted(attempts, key=lambda p: (attempts[p], p[1], p[0])):
            at = (space(p[0]), made[p].lower() if space(p[0]) in ("given", "surname") else made[p])
            if at in taken or at in real:
                redo.append(p)
            taken.add(at)
        if not redo:
            break
        for p in redo:
            attempts[p] += 1

    def capital(old, x):
        if old.lower() == old.upper():
            return x
        return x.upper() if len(old) > 1 and old == old.upper() else x.lower() if old == old.lower() else x

    def whole(m):
        kind = kinds[m]
        if not kind:
            return m
        new = [surrogate(key, *p, attempts.get(p, 0)) for p in parts[m]]
        if kind == "person":
            return TITLE.search(m)[0] + " ".join(capital(w, x) for w, x in zip(TITLE.sub("", m).split(" "), new, strict=True))
        (x,) = new
        if kind == "phone" and national(m) != digits(m):
            x = "1" + x
        if kind in ("phone", "card", "ssn"):
            left = iter(x)
            return "".join(next(left) if "0" <= c <= "9" else c for c in m) + "".join(left)
        if kind == "secret":
            return SECRET.search(m)[0] + x
        if kind == "iban":
            return regex.sub("(.{4})(?=.)", r"\1 ", x) if " " in m else x
        if kind in ("email", "ip6") and regex.search("[A-Z]", m):
            return x.upper() if m == m.upper() else "".join(c.upper() if "A" <= m[i : i + 1] <= "Z" else c for i, c in enumerate(x))
        return x

    def text_of(t):
        known = {}
        for m in ENTITY.findall(t):
            if kinds[m] == "person":
                for w, x in zip(TITLE.sub("", m).split(" "), TITLE.sub("", whole(m)).split(" "), strict=True):
                    if len(w) > 1 and "." not in w and not regex.fullmatch(S._PARTICLE, w):
                        known[plain(w)] = min(known.get(plain(w), initcap(x)), initcap(x))
        bare = lambda p: BARE.sub(lambda f: capital(f[0], known[plain(f[0])]) if plain(f[0]) in known else f[0], p)
        out, at = [], 0
        for f in ENTITY.finditer(t):
            out += [bare(t[at : f.start()]), whole(f[0])]
            at = f.end()
        return "".join([*out, bare(t[at:])])

    return [(i, None if t is None else text_of(t)) for i, t in rows]
