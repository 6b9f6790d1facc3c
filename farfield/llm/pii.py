"""PII surrogates in DataFrame and SQL functions alone.

Entities are found by one pattern and brought to a canonical form (digits of a number, lower-cased address; a name is its
given names and its family name, each an entity of its own). Each distinct entity gets one surrogate from a keyed SHA-512:
of the same kind, script and format, a given name of the same gender. A surrogate must differ from all other surrogates
and from all entities of its kind in the table; one that doesn't is drawn again with the next attempt number, and longer as
attempts go on, so that no format runs out of places. Equal entities therefore read alike everywhere, different ones stay different, and Mr. John Smith, Mr. Smith
and Dr. Smith stay one family. Each mention is then written in its own format, and the text is put together from what lies
between the mentions.

Card numbers must satisfy their check digit, IBANs get a right one. Names are found after a form of address, over up to four
parts with initials and particles (Dr. John F. van der Berg): the last part is the family name, the others are given names,
particles stay, and an initial moves along its alphabet by a step that the key sets. Once a document has a name with a form
of address, the words of that name are replaced wherever the document has them as they are there or in capitals, unless it has
the word in lower case too (Mr. Brown, a brown bear: only the addressed one goes). Birth dates are found after a word for
birth, addresses as number and street. Names of people whom their document never addresses so aren't found.
"""

from __future__ import annotations

import hashlib
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.llm.scratch import free_names, stored

DEFAULT_KEY = "farfield"

#: fixed values: forms of address by gender, names by gender and script, syllables and letters by script
MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|г-н"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Srta|г-жа"
OPEN_TITLES = "Dr|Prof"
PARTICLES = "von|van|vom|der|den|de|del|della|di|da|dos|du|la|le|ten|ter|zu|zur|bin|al"
GIVEN = {
    "m": "Adam Arthur Bruno Carl Daniel David Edgar Emil Felix George Hugo Ian Jonas Karl Leo Louis Martin Max Nils Oscar Otto Paul Peter Robert Simon Theo Thomas Victor Walter Xavier",
    "f": "Ada Alice Anna Bella Clara Diana Edith Elena Emma Flora Grace Hanna Ida Irene Julia Karla Laura Lena Lucia Maria Martha Nina Nora Olga Paula Rosa Sara Sofia Theresa Vera",
}
GIVEN_CYRILLIC = {"m": "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Тимур", "f": "Алла Анна Вера Галина Дарья Елена Жанна Зоя Ирина Кира Лидия Мария Нина Ольга Раиса София"}
GIVEN_GREEK = {"m": "Αλέξης Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Μάριος Νίκος Πέτρος Σταύρος", "f": "Αγγελική Άννα Βασιλική Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα"}
SYLLABLES = "bar bel cor dan del fer gar hol kar lan lor mar mel nor pel ras rol sel tan tor val ver vin wal"
SYLLABLES_CYRILLIC = "бар вел гор дан дор зар кал кор лан лев мар мел нов пет рад сол тар вол"
SYLLABLES_GREEK = "βαρ γαλ δημ θαν καλ λαμ μαν νικ παν ραλ σαρ τσι φαν χρι"
LETTERS = {
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "[\\p{IsCyrillic}]": "абвгдежзиклмнопрстуфхцчшэюя",
    "[\\p{IsGreek}]": "αβγδεζηθικλμνξοπρστυφχψω",
    "[\\p{IsHan}]": "安白成大东方高国海和华金立林美明宁平清山石田文小新",
    "[\\p{IsHiragana}]": "あいうえおかきくけこさしすせそたちつてとなにのはひふへほまみむめもやゆよ",
    "[\\p{IsKatakana}]": "アイウエオカキクケコサシスセソタチツテトナニノハヒフヘホマミムメモヤユヨ",
    "[\\p{IsHangul}]": "가나다라마바사아자차카타파하고노도로모보소오조",
    "[\\p{IsArabic}]": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "[\\p{IsHebrew}]": "אבגדהוזחטיכלמנסעפצקרשת",
    "[\\p{L}]": "àâäçèéêëîïñóôöùûü",
}

_TITLES = f"{MALE_TITLES}|{FEMALE_TITLES}|{OPEN_TITLES}"
_INNER = r"['’-](?!s\b)(?=\p{L})"
_PART = rf"(?:\p{{Lu}}(?:[\p{{L}}\p{{M}}]|{_INNER})+|[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}]{{1,4}}|[\p{{Lo}}&&[^\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}]][\p{{L}}\p{{M}}]*)"
_BEFORE_PART = rf"(?:\p{{Lu}}\. )*(?:(?:{PARTICLES}) )*(?!(?:{_TITLES})\b)"
NAME = rf"\b(?:{_TITLES})\.? {_BEFORE_PART}{_PART}(?: {_BEFORE_PART}{_PART}){{0,3}}"
#: what stands in a name without being a part of it
_BETWEEN = rf"^(?:\p{{Lu}}\.|{PARTICLES})$"
#: places where a word begins or ends
_EDGE = rf"(?<![\p{{L}}\p{{M}}])(?<!\p{{L}}['’-])(?=\p{{L}})|(?<=[\p{{L}}\p{{M}}])(?![\p{{L}}\p{{M}}]|{_INNER})"
EMAIL = r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_WORD_BEFORE = "(?i:token|secret|password|passwd|api_key|apikey|api-key) {0,2}[=:] {0,2}[\"']?"
_PREFIX = "(?:AKIA|ASIA|gh[pousr]_|sk-|xox[baprs]-)"
SECRET = rf"(?=[A-Za-z0-9_/+-]{{12}})(?<={_WORD_BEFORE})[A-Za-z0-9_/+-]{{12,}}|\b{_PREFIX}[A-Za-z0-9-]{{16,}}|\b[0-9a-fA-F]{{32,}}\b"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
IP = r"(?=\d)(?<![\d.])(?<!(?i:version|release|ver|v)[ .]?)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
IP6 = r"(?<![0-9A-Za-z:])(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
BIRTH = r"(?=\d)(?<=(?i:born|born on|dob|date of birth|geboren am|né le|née le):? )(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\d)"
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd"
ADDRESS = rf"\b\d{{1,5}} \p{{Lu}}\p{{L}}+ (?:{_STREETS})\b|\b\p{{Lu}}\p{{L}}+(?:straße|strasse|gasse|platz) \d{{1,4}}\b"
PATTERN = "|".join((SECRET, EMAIL, IBAN, IP6, IP, SSN, BIRTH, PHONE, CARD, ADDRESS, NAME))
#: every match holds a digit, an at sign, one of these words, or 32 letters; a text without any is not searched further
WORDS = "Mr Ms Miss Herr Frau Monsieur Madame Mme Señor Sr Sra Srta Dr Prof г-н г-жа AKIA ASIA ghp_ gho_ ghu_ ghs_ ghr_ sk- xox".split()
HINT = r"[0-9@]|(?i:token|secret|passw|api.?key) {0,2}[=:]|[a-fA-F]{32}"
MARKS = ("\ue000", "\ue001", "\ue002", "\ue003")


def _sql(pattern: str) -> str:
    """A pattern as it stands in a SQL string."""
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _luhn(text: str) -> str:
    """The sum of the check digit rule over a string of digits, modulo 10."""
    return f"""aggregate(transform(filter(split(reverse({text}), ''), x -> x != ''), (x, j) -> case when j % 2 = 0 then cast(x as int)
        when cast(x as int) > 4 then 2 * cast(x as int) - 9 else 2 * cast(x as int) end), 0, (a, b) -> a + b) % 10"""


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
KIND = f"""case
    when m like '%@%' then 'email'
    when m rlike '^[0-9A-Fa-f:]+$' and m like '%:%' then 'ip6'
    when m rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then 'ip'
    when m rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{4}})$' then 'birth'
    when m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then 'ssn'
    when m rlike '^([+(]|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}$)' then 'phone'
    when m rlike '^[0-9][0-9 -]*$' and length({_DIGITS}) between 13 and 19 then
        case when before rlike '{_sql(_WORD_BEFORE)}$' then 'secret' when {_luhn(_DIGITS)} = 0 then 'card' else 'none' end
    when m rlike '{_sql("^(?:" + ADDRESS + ")$")}' then 'address'
    when m rlike '{_sql("^(?:" + _TITLES + ")[.]? ")}' then 'name'
    when m rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9 ]{{11,}}$' and not m rlike '^[0-9A-F]{{32,}}$' then 'iban'
    else 'secret' end"""

_NAMES = f"regexp_replace(m, '{_sql('^(?:' + _TITLES + ')[.]? ')}', '')"
_GENDER = f"case when m rlike '{_sql('^(?:' + MALE_TITLES + ')[. ]')}' then 'm' when m rlike '{_sql('^(?:' + FEMALE_TITLES + ')[. ]')}' then 'f' else 'o' end"
#: a family name without its feminine ending
_FAMILY = lambda x: f"regexp_replace(lower({x}), '(ов|ев|ёв|ин)а$', '$1')"
#: the parts of a name in order, without initials and particles
_NAMED = f"filter(split({_NAMES}, ' '), x -> not x rlike '{_sql(_BETWEEN)}')"
#: the entities of a mention, in order: (kind, canon)
ENTITIES = f"""case
    when kind = 'none' then filter(array(named_struct('kind', kind, 'canon', m)), x -> false)
    when kind = 'name' then transform({_NAMED}, (x, i) -> case when i < size({_NAMED}) - 1 then named_struct('kind', 'given', 'canon', concat({_GENDER}, ':', lower(x)))
        else named_struct('kind', 'family', 'canon', {_FAMILY("x")}) end)
    when kind in ('phone', 'card', 'ssn') then array(named_struct('kind', kind, 'canon', {_DIGITS}))
    when kind in ('email', 'ip6', 'address') then array(named_struct('kind', kind, 'canon', lower(m)))
    when kind = 'iban' then array(named_struct('kind', kind, 'canon', replace(m, ' ', '')))
    when kind = 'birth' and m like '%-%' then array(named_struct('kind', kind, 'canon', m))
    when kind = 'birth' then array(named_struct('kind', kind, 'canon', concat_ws('-', split(m, '[./]')[2], lpad(split(m, '[./]')[1], 2, '0'), lpad(split(m, '[./]')[0], 2, '0'))))
    when m rlike '^[0-9a-fA-F]+$' then array(named_struct('kind', kind, 'canon', lower(m)))
    else array(named_struct('kind', kind, 'canon', m)) end"""

#: digits of the digest d as numbers under 65536, as many as there are asked for by place i
_R = "cast(conv(substring(d, pmod(i * 4, 124) + 1, 4), 16, 10) as int)"
_AT = lambda n: f"cast(conv(substring(d, {n * 4 + 1}, 4), 16, 10) as int)"
_SWAP = "case when c rlike '[0-9]' then cast({r} % 10 as string) " + " ".join(f"when c rlike '{_sql(p)}' then substring('{x}', {{r}} % {len(x)} + 1, 1)" for p, x in LETTERS.items()) + " else c end"


def _swapped(text: str, digest: str = "d") -> str:
    """``text`` with each letter and digit replaced by another of its class and script."""
    return f"array_join(transform(split({text}, ''), (c, i) -> {_SWAP.replace('{r}', _R.replace('substring(d,', f'substring({digest},'))}), '')"


def _hexed(text: str) -> str:
    """``text`` with each hexadecimal digit replaced by one of the digest."""
    return f"array_join(transform(split({text}, ''), (c, i) -> case when c rlike '[0-9a-f]' then substring(d, pmod(i * 5, 127) + 1, 1) else c end), '')"


def _pick(words: str, n: str) -> str:
    """One of some words by the number at place n of the digest."""
    items = words.split()
    quoted = ", ".join(f"'{w}'" for w in items)
    return f"element_at(array({quoted}), cast(conv(substring(d, ({n}) * 4 + 1, 4), 16, 10) as int) % {len(items)} + 1)"


def _syllables(words: str, least: int) -> str:
    """So many syllables, and one more after every fourth attempt."""
    return f"array_join(transform(sequence(2, {least + 1} + attempt div 4), n -> {_pick(words, 'n')}), '')"


def _check_digits(iban: str) -> str:
    """The two check digits of an IBAN whose own are 00."""
    moved = f"concat(substring({iban}, 5), substring({iban}, 1, 2), '00')"
    rest = f"aggregate(filter(split({moved}, ''), c -> c != ''), 0, (a, c) -> case when c rlike '[0-9]' then (a * 10 + cast(c as int)) % 97 else (a * 100 + ascii(c) - 55) % 97 end)"
    return f"lpad(cast(98 - {rest} as string), 2, '0')"


_SCRIPTS = (("[\\p{IsCyrillic}]", GIVEN_CYRILLIC, SYLLABLES_CYRILLIC, 2, "ов"), ("[\\p{IsGreek}]", GIVEN_GREEK, SYLLABLES_GREEK, 2, "ης"), ("[\\p{IsLatin}]", GIVEN, SYLLABLES, 3, ""))


#: the part of an entity whose letters and digits are swapped one by one
_RAW = f"""case kind when 'email' then substring_index(canon, '@', 1) when 'iban' then substring(canon, 5) when 'given' then substring(canon, 3)
    when 'secret' then regexp_replace(canon, '^{_PREFIX}', '') else canon end"""
#: places more than the entity has: none in the first attempts
_MORE = "case when kind in ('family', 'given') then attempt div 4 else greatest(0, attempt - 7) div 4 end"
_LONGER = "case when kind in ('family', 'given') then repeat(right(raw, 1), more) when kind = 'iban' then repeat('A', more) else repeat('a', more) end"
_LONGER_HEX = """case when more = 0 then canon when kind = 'ip6' then concat(array_join(transform(split(canon, ':'), g -> case when g = '' then g else lpad(g, 4, '0') end), ':'), repeat('0', more - 1))
    else concat(canon, repeat('0', more)) end"""
_NUMBER = f"array_join(transform(split(concat(canon, repeat('0', more)), ''), (c, i) -> case when c = '' then '' when i = 0 then case when kind = 'ssn' then cast(1 + {_R} % 8 as string) else c end when i = 1 and kind = 'phone' then cast(2 + {_R} % 8 as string) else cast({_R} % 10 as string) end), '')"


def _surrogates(entities: DataFrame) -> DataFrame:
    """Adds s, the surrogate of (kind, canon) for the digest d. What several kinds share is a column of its own."""
    octets = [f"cast({'1 + ' if k in (0, 3) else ''}{_AT(k)} % {(223, 256, 256, 254)[k]} as string)" for k in range(4)]
    kept = "case when attempt >= 16 then 0 when canon like '10.%' then 1 when canon like '192.168.%' then 2 when canon like '127.%' then 1 else 0 end"
    ip = "concat_ws('.', " + ", ".join(f"case when {kept} > {k} then split(canon, '[.]')[{k}] else {octets[k]} end" for k in range(4)) + ")"
    domain = "substring_index(canon, '@', -1)"
    last = f"substring_index({domain}, '.', -1)"
    host = _swapped(f"substring({domain}, 1, length({domain}) - length({last}))", "dd")
    body, unchecked = "substring(digits, 1, length(digits) - 1)", "concat(substring(canon, 1, 2), '00', swapped)"
    card = f"concat({body}, cast((10 - {_luhn(f'concat({body}, 0)')}) % 10 as string))"
    iban = f"concat(substring(canon, 1, 2), {_check_digits(unchecked)}, swapped)"
    birth = f"concat_ws('-', cast(1930 + {_AT(0)} % (76 + 100 * attempt) as string), lpad(cast(1 + {_AT(1)} % 12 as string), 2, '0'), lpad(cast(1 + {_AT(2)} % 28 as string), 2, '0'))"
    number = f"cast(1 + {_AT(0)} % cast(pow(10, length(regexp_extract(canon, '[0-9]+', 0))) - 1 as int) as string)"
    address = f"concat({number}, '|', {_syllables(SYLLABLES, 2)})"
    family = " ".join(f"when raw rlike '{_sql(script)}' then concat({_syllables(words, n)}, '{end}')" for script, _, words, n, end in _SCRIPTS)
    known = " ".join(f"when substring(canon, 3) in ({', '.join(repr(x.lower()) for names in (GIVEN, GIVEN_CYRILLIC, GIVEN_GREEK) for x in names[g].split())}) then '{g}'" for g in "mf")
    gender = f"case when canon like 'm:%' then 'm' when canon like 'f:%' then 'f' {known} when {_AT(1)} % 2 = 0 then 'f' else 'm' end"
    given = " ".join(
        f"when raw rlike '{_sql(script)}' then concat(case when {gender} = 'm' then {_pick(names['m'], '0')} else {_pick(names['f'], '0')} end, case when attempt < 4 then '' else {_syllables(words, 0)} end)"
        for script, names, words, _, _ in _SCRIPTS
    )
    secret = "case when canon rlike '^[0-9a-f]*[a-f][0-9a-f]*$' then hexed else concat(substring(canon, 1, length(canon) - length(raw)), swapped) end"
    shared = entities.withColumns({"raw": F.expr(_RAW), "more": F.expr(f"cast({_MORE} as int)")})
    shared = shared.withColumns({"swapped": F.expr(_swapped(f"concat(raw, {_LONGER})")), "digits": F.expr(f"case when kind in ('card', 'phone', 'ssn') then {_NUMBER} end"), "hexed": F.expr(f"case when kind in ('ip6', 'secret') then {_hexed(_LONGER_HEX)} end")})
    return shared.withColumn(
        "s",
        F.expr(
            f"""case kind
            when 'card' then {card}
            when 'phone' then digits
            when 'ssn' then digits
            when 'ip' then {ip}
            when 'ip6' then hexed
            when 'email' then concat(swapped, '@', {host}, {last})
            when 'iban' then {iban}
            when 'birth' then {birth}
            when 'address' then {address}
            when 'family' then case {family} else swapped end
            when 'given' then case {given} else swapped end
            else {secret} end"""
        ),
    )


#: one letter or digit after the other of s in the places of the letters and digits of m, and what is left over at the end
_FILL = """aggregate(split(m, ''), named_struct('t', cast('' as string), 'j', 1), (a, c) ->
    case when c rlike '[0-9A-Za-z]' then named_struct('t', concat(a.t, substring(s[0], a.j, 1)), 'j', a.j + 1)
         else named_struct('t', concat(a.t, c), 'j', a.j) end, a -> concat(a.t, substring(s[0], a.j)))"""


def _cased(part: str, s: str) -> str:
    """A name's surrogate in the case of the name, and with its feminine ending."""
    ended = f"concat({s}, case when lower({part}) rlike '(ов|ев|ёв|ин)а$' and {s} rlike 'ов$' then 'а' else '' end)"
    return f"case when {part} = upper({part}) and {part} != lower({part}) and length({part}) > 1 then upper({ended}) else initcap({ended}) end"


_CAPITALS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")


def _initial(x: str, key: str) -> str:
    """An initial moved along its alphabet by a step that the key sets: equal ones stay equal, different ones different."""
    step = int(hashlib.sha512(f"{key}|initial".encode()).hexdigest(), 16)
    moved = [letters[1 + step % (len(letters) - 1) :] + letters[: 1 + step % (len(letters) - 1)] for letters in _CAPITALS]
    return f"translate({x}, '{''.join(_CAPITALS)}', '{''.join(moved)}')"


def _name(key: str) -> str:
    """A name written from s: particles stay, initials move, each part is the next surrogate."""
    return f"""substring(aggregate(split({_NAMES}, ' '), named_struct('t', cast('' as string), 'j', 0), (a, x) ->
        case when x rlike '{_sql(_BETWEEN)}' then named_struct('t', concat(a.t, ' ', case when x like '%.' then {_initial("x", key)} else x end), 'j', a.j)
             else named_struct('t', concat(a.t, ' ', {_cased("x", "s[a.j]")}), 'j', a.j + 1) end).t, 2)"""


def _mention(key: str) -> str:
    """A mention m written from its surrogates s, in its own format."""
    return f"""case
    when kind = 'none' then m
    when kind in ('phone', 'card', 'ssn', 'iban') then {_FILL}
    when kind = 'name' then concat(regexp_extract(m, '{_sql("^(?:" + _TITLES + ")[.]? ")}', 0), {_name(key)})
    when kind = 'birth' and not m like '%-%' then concat(substring(s[0], 9, 2), substring(regexp_extract(m, '[./]', 0), 1, 1), substring(s[0], 6, 2), substring(regexp_extract(m, '[./]', 0), 1, 1), substring(s[0], 1, 4))
    when kind = 'address' and m rlike '^[0-9]' then concat(split(s[0], '[|]')[0], ' ', initcap(split(s[0], '[|]')[1]), ' ', substring_index(m, ' ', -1))
    when kind = 'address' then concat(initcap(split(s[0], '[|]')[1]), regexp_extract(m, '(straße|strasse|gasse|platz)', 1), ' ', split(s[0], '[|]')[0])
    when kind = 'email' and m = upper(m) and m != lower(m) then upper(s[0])
    when kind in ('secret', 'ip6') and lower(m) rlike '^[0-9a-f:]+$' then array_join(zip_with(split(m, ''), split(s[0], ''), (a, b) -> case when a rlike '[A-F]' or m = upper(m) then upper(b) else b end), '')
    else s[0] end"""


def _may(text: Column) -> Column:
    found = text.rlike(HINT)
    for word in WORDS:
        found = found | text.contains(word)
    return F.coalesce(found, F.lit(False))


def _pieces(text: Column) -> Column:
    """The text cut at its mentions: what lies between them at even places, the mentions at odd ones.

    The pattern runs once and sets a mark that the text doesn't hold on both sides of a mention. A text that holds all
    ``MARKS`` is cut by two runs.
    """
    mark = F.coalesce(*[F.when(~text.contains(m), F.lit(m)) for m in MARKS])
    once = F.split(F.regexp_replace(text, F.lit(f"({PATTERN})"), F.concat(mark, F.lit("$1"), mark)), mark, -1)
    found = F.concat(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array(F.lit("")))
    twice = F.flatten(F.zip_with(F.split(text, PATTERN, -1), found, lambda p, m: F.array(p, m)))
    return F.when(mark.isNotNull(), once).otherwise(F.slice(twice, F.lit(1), F.size(twice) - 1))


def mentions(rows: DataFrame) -> DataFrame:
    """(key, at, m, kind, entities) of (key, p), p a text's pieces: every mention, in order of at."""
    listed = F.expr("filter(transform(p, (x, i) -> named_struct('at', i, 'm', x, 'before', case when i > 0 then right(p[i - 1], 24) else '' end)), x -> x.at % 2 = 1)")
    found = rows.where("size(p) > 1").select("key", F.inline(listed)).withColumn("kind", F.expr(KIND))
    return found.select("key", "at", "m", "kind", F.expr(ENTITIES).alias("entities"))


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, s) for distinct (kind, canon): surrogates that meet no entity and no other surrogate of their kind.

    What met one is drawn again, longer after a few attempts (private addresses leave their range), until all are settled.
    """
    entities = stored(entities.select("kind", "canon").distinct(), "entities")
    taken = entities.select("kind", F.expr("case when kind = 'given' then substring(canon, 3) else canon end").alias("s_key")).distinct().withColumn("clash", F.lit(True))
    left, done = entities, None
    for attempt in count():
        digest = F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", F.lit(str(attempt))), 512)
        domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index("canon", "@", -1)), 512)
        drawn = _surrogates(left.withColumns({"d": digest, "dd": domain, "attempt": F.lit(attempt)})).withColumn("s_key", F.lower("s")).select("kind", "canon", "s", "s_key")
        first = drawn.groupBy("kind", "s_key").agg(F.min("canon").alias("first"))
        ok = F.col("clash").isNull() & (F.col("first") == F.col("canon"))
        drawn = stored(drawn.join(first, ["kind", "s_key"]).join(taken, ["kind", "s_key"], "left").withColumn("ok", ok).drop("clash", "first"), "drawn")
        good = drawn.where("ok").select("kind", "canon", "s")
        done = good if done is None else done.union(good)
        left = drawn.where("not ok").select("kind", "canon")
        if left.isEmpty():
            return done
        taken = taken.union(drawn.where("ok").select("kind", "s_key", F.lit(True).alias("clash"))).distinct()


#: (word, given, new) for the parts of a name m that is written as w, if their script has case, and the same in capitals
_WRITTEN_PARTS = f"""case when kind = 'name' then filter(transform(zip_with(split({_NAMES}, ' '), split({_NAMES.replace("(m,", "(w,")}, ' '), (x, y) -> named_struct('word', x, 'new', y)),
    (x, i) -> named_struct('word', x.word, 'given', i < size(split({_NAMES}, ' ')) - 1, 'new', x.new)), x -> x.word != lower(x.word) and not x.word rlike '{_sql(_BETWEEN)}') end"""
_IN_CAPITALS = "concat(parts, transform(parts, x -> named_struct('word', upper(x.word), 'given', x.given, 'new', upper(x.new))))"


def _per_document(written: DataFrame) -> DataFrame:
    """(key, w, n, names): the mentions of a document in order, how many hold an entity, and the new form of each name's words."""
    written = written.withColumn("parts", F.expr(_WRITTEN_PARTS)).withColumn("parts", F.expr(_IN_CAPITALS))
    out = written.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("w"), F.count_if(F.col("kind") != "none").alias("n"), F.flatten(F.collect_list("parts")).alias("parts"))
    out = out.withColumns({"w": F.col("w.w"), "parts": F.array_sort(F.array_distinct("parts"))})
    first = F.expr("transform(filter(parts, (x, i) -> i = 0 or parts[i - 1].word != x.word), x -> named_struct('word', x.word, 'new', x.new))")
    return out.select("key", "w", F.col("n").cast("int").alias("n"), F.when(F.size("parts") > 0, F.map_from_entries(first)).alias("names"))


def surrogate(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """``docs``, all columns, with each PII mention in ``text`` replaced, and n_entities (int, mentions replaced) added.

    Texts without PII come back as they are, null as null. Repeated rows and null ids get the same replacements. A given
    name of unknown gender takes that which the table knows for it, if it is one, else that of the lists of names. The surrogates depend on ``key`` and on
    the distinct entities of the table alone, not on how it is partitioned. The mentions of a document are gathered in one
    row: as many as its text holds. Its words are looked up among those of its addressed names that it also has without a
    form of address; a word that is given and family name in one document is taken as the family name there. No rows give
    no rows. Other columns pass through, whatever their names (an n_entities of the input is replaced).
    """
    id_, p_, w_, names_, words_, n_ = free_names(docs, "key", "pieces", "written", "names", "words", "n")
    names = [c for c in docs.columns if c != "n_entities"]
    rows = docs.withColumn("text", F.col("text").cast("string")).select(*names)
    may = _may(F.col("text"))
    pieces = rows.where(may).withColumns({id_: F.xxhash64(F.col("doc_id").cast("long"), "text"), p_: _pieces(F.col("text"))}).drop("text")
    pieces = stored(pieces, "pieces")
    known = stored(mentions(pieces.select(F.col(id_).alias("key"), F.col(p_).alias("p"))).dropDuplicates(["key", "at"]), "mentions")
    parts = known.select("key", "at", F.posexplode("entities").alias("j", "e")).select("key", "at", "j", "e.kind", "e.canon")
    gendered = parts.where("kind = 'given' and canon not like 'o:%'").groupBy(F.substring("canon", 3, 1_000_000).alias("given"))
    gendered = gendered.agg(F.min(F.substring("canon", 1, 1)).alias("one"), F.max(F.substring("canon", 1, 1)).alias("other")).where("one = other").select("given", "one")
    open_ = F.expr("case when kind = 'given' and canon like 'o:%' then substring(canon, 3) end")
    parts = parts.withColumn("given", open_).join(gendered, "given", "left").withColumn("canon", F.when(F.col("one").isNotNull(), F.concat("one", F.lit(":"), "given")).otherwise(F.col("canon")))
    parts = stored(parts.select("key", "at", "j", "kind", "canon"), "parts")
    drawn = parts.join(mapping(parts, key), ["kind", "canon"]).groupBy("key", "at").agg(F.array_sort(F.collect_list(F.struct("j", "s"))).alias("s"))
    drawn = drawn.withColumn("s", F.col("s.s"))
    written = known.select("key", "at", "m", "kind").join(drawn, ["key", "at"], "left").select("key", "at", "m", "kind", F.expr(_mention(key)).alias("w"))
    hit = pieces.join(_per_document(written).toDF(id_, w_, n_, names_), id_, "left")
    # the words between the mentions, and of the names those that stand among them and are no common words
    hit = hit.withColumn(words_, F.expr(f"case when {names_} is not null then transform({p_}, (x, i) -> case when i % 2 = 0 then split(x, '{_sql(_EDGE)}') else array('') end) end"))
    live = f"""map_filter({names_}, (k, v) -> array_contains(array_intersect(map_keys({names_}), flatten({words_})), k)
        and not array_contains(array_intersect(transform(map_keys({names_}), x -> lower(x)), flatten({words_})), lower(k)))"""
    hit = hit.withColumn(names_, F.expr(live))
    hit = hit.withColumn(n_, F.expr(f"coalesce({n_}, 0) + case when size({names_}) > 0 then size(filter(flatten({words_}), x -> map_contains_key({names_}, x))) else 0 end"))
    between = f"case when size({names_}) > 0 then array_join(transform({words_}[i], y -> coalesce(try_element_at({names_}, y), y)), '') else x end"
    hit = hit.withColumn("text", F.expr(f"array_join(transform({p_}, (x, i) -> case when i % 2 = 0 then {between} else {w_}[cast((i - 1) / 2 as int)] end), '')"))
    return hit.select(*names, F.col(n_).alias("n_entities")).union(rows.where(~may).select(*names, F.lit(0).alias("n_entities")))
