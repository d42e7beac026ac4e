"""Personal data: detected entities get keyed surrogates of the same type, gender, script and format. DataFrame functions only.

Types: email, phone, card (13 to 19 digits with a right check digit), ip (four numbers up to 255), ssn, iban (right check
digits), and person names: after a title, after a known given name (also in capitals, with an initial or a particle between), or after words that
announce one ("my name is", "Dear"). Given names beyond the short list here are a parameter. Phones have a country code, a national prefix 0 and separators, or the
groups 3-3-4. Anything else, such as a number of 16 digits with a wrong check digit or plain digits without prefix, is left alone.

An entity is a canonical value: an e-mail in lower case, a phone's last ten digits without country code and prefix 0, digits or letters without their
separators, a name without its title in lower case. Its surrogate comes from SHA-256 over (key, type, value,
attempt): digits for digits, letters of the same script and case, given names and surnames of the same gender and script (Latin, Cyrillic, Greek; names
in other scripts get letters of their own); a card
keeps its first digit and gets a right check digit, an IBAN its country, an e-mail its top-level domain and the shape of
its parts, and a mention keeps its own separators, title and upper case. Mentions of one entity get one surrogate
everywhere (coreference). Rounds of collision checks over the table of distinct entities give a further attempt to all but the least of
those that share a surrogate, and to any whose surrogate is an entity of the corpus: different entities stay different. From attempt WIDEN on
a type whose values are used up grows: phones, SSNs by digits, e-mails by letters, names by syllables, ip by a port; so rounds end.

All texts are scanned once and staged with their mentions. Rows without entities then pass as they are, unshuffled; mentions of the others are
joined with the surrogates (Spark splits an entity that fills many rows) and put back by row. A null text stays null; an empty one stays
empty. Repeated rows, null ids and ties are rows of their own; an empty table gives no rows. Other columns
pass through, whatever their names; only one called n_entities is replaced."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Given names by script and gender, titles with their gender, words before a name, and syllables and endings for surnames.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Sophie Emma Clara Elena Marta Ines Carla Lucia Alice Camille Greta Heidi Ingrid Nora Olivia Emily Grace Hannah Susan Helen Karen Linda Fatima Aisha Priya Mei Yuki Chiara Jane Mary Sarah Amina".split(),
    ("latin", "m"): "John Peter Paul Thomas Martin Lukas Felix Jonas Pablo Diego Carlos Javier Pierre Louis Henri Marcel Hans Jürgen Klaus Robert James David Daniel Michael George Edward Ahmed Mohammed Omar Raj Hiroshi Giovanni William Richard Joseph Wei".split(),
    ("latin", "n"): "Alex Robin Kim Sascha Sam Jamie Taylor Jordan Casey Morgan".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел".split(),
    ("cyrillic", "n"): "Саша Женя Валя".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Ανδρέας Παύλος".split(),
    ("greek", "n"): "Αγγελική Ευάγγελος".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña Г-жа Κυρία Κα".split(), "m": "Mr Herr Monsieur Señor Sr Don Г-н Κύριος Κος".split(), "n": "Dr Prof Mx Δρ".split()}
CUES = ("name is", "name's", "named", "Name:", "Dear", "Regards,", "Sincerely,", "signed by", "Name ist", "heiße", "heißt", "Liebe", "Lieber", "appelle", "nom est", "Nom :", "Cher", "Chère", "llamo", "nombre es", "Nombre:", "Querido", "Querida", "зовут", "λένε")
PARTICLES = "van von de der den del della di da dos la le al el bin ibn".split()
SYLLABLES = {
    "latin": "bar bel dor fen gar hol kel lan mar nor pel ros sal tor val wen zim cor dan ber".split(), "cyrillic": "бар вол гор дан зор кал лан мир нов рос сав тар чер шал бел дор".split(),
    "greek": "βαρ γαλ δερ ζαν καλ λαμ μαν νικ παπ ραλ σταμ τσαν φιλ χατζ".split(),
}
ENDINGS = {
    "latin": dict.fromkeys("fmn", ["er", "mann", "ton", "ez", "ier", "ski"]), "cyrillic": {"f": ["ова", "ина", "енко", "ская"], "m": ["ов", "ин", "енко", "ский"], "n": ["енко", "ко", "юк", "их"]},
    "greek": {"f": ["ίδου", "οπούλου", "άκη", "ή"], "m": ["ίδης", "όπουλος", "άκης", "ής"], "n": ["ίδη", "άκη", "έα", "ού"]},
}
#: What a surname's ending says about gender where neither title nor given name does.
GENDERED = {"f": "(?:ова|ева|ёва|ина|ская|ου|ίδου)$", "m": "(?:ов|ев|ёв|ин|ский|ος|ης|ής)$"}

LETTER = r"[\p{L}\p{N}]"
#: A capitalised word, perhaps with inner capitals or an apostrophe (McDonald, O'Brien), or two with a hyphen.
WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:['’]?\p{Lu}\p{Ll}+)*"
CAPITAL = rf"{WORD}(?:-{WORD})?"
CAPITALS = r"\p{Lu}(?:['’-]?\p{Lu})+"
#: One pattern for all mentions, so that each character belongs to one of them at most; the first alternative that matches wins.
EMAIL = r"[\p{L}\p{N}_%+-](?:[\p{L}\p{N}._%+-]*+)@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
NUMBERS = "|".join((
    r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}", r"\+\d{1,3}[ ./-]?(?:\(\d{1,2}\)(?:[ ./-]?\d){4,10}|\(\d{3,4}\)(?:[ ./-]?\d){4,8}|\d(?:[ ./-]?\d){4,11})(?![.]\d)", r"\+\d{8,15}", r"\d{3}([ .-])\d{3}\1\d{4}",
    r"\d{3}-\d{2}-\d{4}", r"(?:\d{1,3}\.){3}\d{1,3}(?!\.\d)", r"\d{13,19}", r"\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}", r"\d{4}[ -]\d{6}[ -]\d{5}", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    # With a national prefix: five pairs, or an area code and one to four groups.
    r"0[1-9]([ .-])\d{2}\3\d{2}\3\d{2}\3\d{2}(?![.]\d)", r"(?:0[1-9]\d{1,4} ?[ /-] ?|\(0[1-9]\d{0,4}\)[ /-]?)(?:\d{5,8}|\d{3,4}[ -]\d{3,5}|\d{2,3}[ -]\d{2}[ -]\d{2}(?:[ -]\d{2})?)(?![.]\d)",
))
#: What stands before a phone's own digits: a country code (of one digit, of two, or else of three), with (0) or without, or the prefix 0.
PREFIX = r"^(?:(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})[ ./-]?(?:\(0\))?|0(?=[1-9])|\(0(?=[1-9]\d{0,4}\)[ /-]?\d{5}))"
def _either(words) -> str:
    """A pattern for any of the words, grouped by their first letters: most places of a text are done with one test."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(c + "(?:" + "|".join(sorted(rest, key=len, reverse=True)) + ")" for c, rest in by.items()) + ")"


TITLES_ALL = [t for names in TITLES.values() for t in names]
TITLE, TITLE_CAPS = _either(TITLES_ALL), _either([t.upper() for t in TITLES_ALL])
SURNAME = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{CAPITAL}"
#: A name may begin here: a capital behind one of the cues.
ANNOUNCED = rf"(?<=(?:{'|'.join(CUES)})[ \n]{{1,2}})"


def _known(given: dict) -> list[str]:
    return [n for names in given.values() for n in names]


def _mention(given: dict) -> str:
    known = _known(given)
    more = rf"(?: (?:\p{{Lu}}\. )?{SURNAME})"
    name = "|".join((rf"{TITLE}\.? {CAPITAL}{more}?", rf"{_either(known)}{more}", rf"(?:{TITLE_CAPS}\.?|{_either([n.upper() for n in known])}) {CAPITALS}(?!\p{{Ll}})", rf"{ANNOUNCED}{CAPITAL}{more}?"))
    return rf"(?<![\p{{L}}\p{{N}}._%+-])(?:{EMAIL}|(?:(?=[+(0-9A-Z])(?:{NUMBERS})|(?=\p{{Lu}})(?:{name}))(?!{LETTER}))"


#: No \b in it, which in some versions of Java knows ASCII letters only.
MENTION = _mention(GIVEN)

DIGITS, LOWER, UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüý"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
ARMENIAN = "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ"
ALPHABETS = (DIGITS, LOWER, UPPER, ACCENTED, ACCENTED.upper(), CYRILLIC, CYRILLIC.upper(), GREEK, GREEK.upper(), ARMENIAN, ARMENIAN.upper())
#: The attempt from which surrogates of a type outgrow its format.
WIDEN = 24


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _like(column: str, pattern: str) -> str:
    return f"regexp_like({column}, {_sql(pattern)})"


def _luhn(digits: str) -> str:
    """SQL for the check sum of a string of digits, whose last counts once."""
    return f"""aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE WHEN (length({digits}) - i) % 2 = 0 THEN int(substr({digits}, i, 1))
        WHEN int(substr({digits}, i, 1)) > 4 THEN int(substr({digits}, i, 1)) * 2 - 9 ELSE int(substr({digits}, i, 1)) * 2 END) % 10"""


def _mod97(iban: str) -> str:
    """SQL for an IBAN's value mod 97: its first four characters go last, letters count from 10."""
    return f"aggregate(split(concat(substr({iban}, 5), left({iban}, 4)), ''), 0, (a, c) -> IF(c = '', a, IF(c < 'A', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97)))"


def kind_of(m: str) -> str:
    """SQL for the type of a mention, null if it is none."""
    digits, solid = f"regexp_replace({m}, '[^0-9]', '')", f"regexp_replace({m}, ' ', '')"
    return f"""CASE WHEN {_like(m, '@')} THEN 'email'
        WHEN {_like(m, r'^(?:[0-9]{1,3}[.]){3}[0-9]{1,3}$')} THEN IF(forall(split({m}, '[.]'), x -> int(x) <= 255), 'ip', NULL)
        WHEN {_like(m, r'^[0-9]{3}-[0-9]{2}-[0-9]{4}$')} THEN 'ssn'
        WHEN {_like(m, r'^[0-9](?:[ -]?[0-9]){12,18}$')} THEN IF({_luhn(digits)} = 0, 'card', NULL)
        WHEN {_like(m, r'^[A-Z]{2}[0-9]{2}')} THEN IF(length({solid}) BETWEEN 15 AND 34 AND {_mod97(solid)} = 1, 'iban', NULL)
        WHEN {_like(m, r'^[+(0-9]')} THEN IF(length({digits}) BETWEEN 7 AND 15, 'phone', NULL)
        ELSE 'name' END"""


def _untitled(m: str) -> str:
    return f"regexp_replace({m}, {_sql(rf'^(?:{TITLE}|{TITLE_CAPS})[.]? ')}, '')"


def value_of(m: str, kind: str, given: dict | None = None) -> str:
    """SQL for the canonical value; a name's is followed by its gender and script."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    first = {g: "|".join(n for (_, x), names in (given or GIVEN).items() if x == g for n in names) for g in "fm"}
    gender = "CASE " + " ".join([f"WHEN {_like(m, '^(?iu:' + '|'.join(TITLES[g]) + ')[. ]')} OR {_like(_untitled(m), f'^(?iu:{first[g]}) ')} THEN '{g}'" for g in "fm"] + [f"WHEN {_like(m, GENDERED[g])} THEN '{g}'" for g in "fm"]) + " ELSE 'n' END"
    script = "CASE " + " ".join(f"WHEN {_like(m, rf'\p{{Is{c.title()}}}[^ ]*$')} THEN '{c}'" for c in SYLLABLES) + " ELSE 'other' END"
    return f"""CASE {kind} WHEN 'email' THEN lower({m}) WHEN 'phone' THEN right(regexp_replace(regexp_replace({m}, {_sql(PREFIX)}, ''), '[^0-9]', ''), 10) WHEN 'ip' THEN {m}
        WHEN 'card' THEN {digits} WHEN 'ssn' THEN {digits} WHEN 'iban' THEN regexp_replace({m}, ' ', '')
        WHEN 'name' THEN concat(translate(lower({_untitled(m)}), '’', "'"), '|', {gender}, '|', {script}) END"""


def _number(seed: str, i: str) -> str:
    """SQL for the i-th number, 0 to 65535, of the stream of a seed."""
    return f"int(conv(substr(sha2(concat({seed}, '#', ({i}) div 16), 256), 1 + 4 * (({i}) % 16), 4), 16, 10))"


def _substituted(text: str, seed: str, first: str | None = None) -> str:
    """SQL for `text` with each character drawn anew from its own alphabet; others stay. A leading 0 of numbers is drawn from 2 to 9."""
    cases = " ".join(f"WHEN locate(substr({text}, i, 1), {_sql(a)}) > 0 THEN substr({_sql(a)}, 1 + {_number(seed, 'i')} % {len(a)}, 1)" for a in ALPHABETS)
    return f"array_join(transform(sequence(1, length({text})), i -> CASE {f'WHEN i = 1 THEN {first}' if first else ''} {cases} ELSE substr({text}, i, 1) END), '')"


def _pick(options: list[str], n: str) -> str:
    return f"element_at(array({', '.join(map(_sql, options))}), 1 + ({n}) % {len(options)})"


def surrogate(kind: str, value: str, seed: str, attempt: str) -> str:
    """SQL for the surrogate of a canonical value; `seed` holds key, type and value."""
    s = f"concat({seed}, '|', {attempt})"
    # What a value grows by when its type's space is used up: four digits, or letters, for each WIDEN attempts.
    grown = f"substr({{0}}, 1, 4 * ({attempt} div {WIDEN}))"
    more_digits, more_letters = (grown.format(_substituted(f"repeat('{c}', 4 * ({attempt} div {WIDEN}))", f"concat({s}, '+')")) for c in "1a")
    name, gender, script = (f"split_part({value}, '|', {i})" for i in (1, 2, 3))
    first, word = f"element_at(split({name}, ' '), 1)", f"element_at(split({name}, ' '), -1)"
    given = "CASE " + " ".join(f"WHEN {gender} = '{g}' AND {script} = '{c}' THEN {_pick(names, f'{_number(seed, '0')} + {attempt}')}" for (c, g), names in GIVEN.items()) + f" ELSE initcap({_substituted(first, s)}) END"
    # Names of one word, and the last of two, get a surname by the word alone, so relatives stay relatives.
    family = f"concat(left({seed}, 64), {word})"
    joined = f"IF({attempt} < IF({_like(name, ' ')}, 8, 1), '', concat('-', initcap(" + "{0}" + ")))"

    def surname(c: str) -> str:
        ending = lambda n: "CASE " + " ".join(f"WHEN {gender} = '{g}' THEN {_pick(e, n)}" for g, e in ENDINGS[c].items()) + " END"
        syllable = lambda of, i: _pick(SYLLABLES[c], _number(of, i))
        more = f"concat({syllable(s, '5')}, {syllable(s, '6')}, IF({attempt} < {WIDEN}, '', concat({syllable(s, '8')}, {syllable(s, '9')})), {ending(_number(s, '7'))})"
        return f"concat(initcap({syllable(family, '1')}), {syllable(family, '2')}, {syllable(family, '3')}, {ending(_number(family, '4'))}, {joined.format(more)})"

    last = f"CASE {script} " + " ".join(f"WHEN '{c}' THEN {surname(c)}" for c in SYLLABLES) + f" ELSE concat(initcap({_substituted(word, family)}), {joined.format(_substituted(word, s))}) END"
    domain = f"regexp_extract({value}, '@(.*)[.][^.]*$', 1)"
    card = _substituted(f"left({value}, length({value}) - 1)", s, f"left({value}, 1)")
    iban = f"concat(left({value}, 2), '00', {_substituted(f'substr({value}, 5)', s)})"
    return f"""CASE {kind}
        WHEN 'email' THEN concat({_substituted(f"split_part({value}, '@', 1)", s)}, {more_letters}, '@', {_substituted(domain, f"concat(left({seed}, 64), {domain}, IF({attempt} < 8, '', string({attempt})))")}, '.', regexp_extract({value}, '[^.]*$', 0))
        WHEN 'phone' THEN concat({_substituted(value, s, f"string(2 + {_number(s, '0')} % 8)")}, {more_digits})
        WHEN 'ssn' THEN concat({_substituted(value, s, "'9'")}, {more_digits})
        WHEN 'ip' THEN concat(concat_ws('.', 11 + {_number(s, '0')} % 200, {_number(s, '1')} % 256, {_number(s, '2')} % 256, 1 + {_number(s, '3')} % 254), IF({attempt} < {WIDEN}, '', concat(':', 1024 + {_number(s, '4')} % 64000)))
        WHEN 'card' THEN transform(array({card}), c -> concat(c, (10 - {_luhn("concat(c, '0')")}) % 10))[0]
        WHEN 'iban' THEN transform(array({iban}), c -> concat(left(c, 2), lpad(98 - {_mod97('c')}, 2, '0'), substr(c, 5)))[0]
        WHEN 'name' THEN IF({_like(name, ' ')}, concat({given}, ' ', {last}), {last}) END"""


def _rewritten(m: str, kind: str, value: str, new: str) -> str:
    """SQL for a mention with its entity's surrogate in its own format."""
    # Digits and letters of the surrogate take the mention's places, from the right, so that a country code in front stays; what is over follows.
    slots, core = f"regexp_replace({m}, '[^0-9A-Z]', '')", f"left({new}, length({value}))"
    filled = f"""aggregate(sequence(1, length({m})), named_struct('k', length({value}) - length({slots}), 'out', ''), (a, i) -> IF(regexp_like(substr({m}, i, 1), '[0-9A-Z]'),
        named_struct('k', a.k + 1, 'out', concat(a.out, IF(a.k >= 0, substr({core}, a.k + 1, 1), substr({m}, i, 1)))), named_struct('k', a.k, 'out', concat(a.out, substr({m}, i, 1)))), a -> concat(a.out, substr({new}, length({value}) + 1)))"""
    cased = f"array_join(transform(sequence(1, length({new})), i -> IF(substr({m}, i, 1) != lower(substr({m}, i, 1)), upper(substr({new}, i, 1)), substr({new}, i, 1))), '')"
    bare = _untitled(m)
    name = f"concat(left({m}, length({m}) - length({bare})), IF({bare} = upper({bare}), upper({new}), {new}))"
    return f"CASE {kind} WHEN 'email' THEN {cased} WHEN 'ip' THEN {new} WHEN 'name' THEN {name} ELSE {filled} END"


def _canonical(kind: str, new: str, value: str) -> str:
    """SQL for a surrogate as a canonical value, to compare it with the corpus's entities."""
    return f"CASE {kind} WHEN 'name' THEN concat(lower({new}), '|', split_part({value}, '|', 2), '|', split_part({value}, '|', 3)) WHEN 'email' THEN lower({new}) ELSE {new} END"


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate for distinct (kind, value): all different in a kind, and none an entity itself."""
    seed = f"concat(sha2(concat({_sql(key)}, '|', kind), 256), value)"
    draw = lambda df: df.withColumn("surrogate", F.expr(surrogate("kind", "value", seed, "attempt"))).withColumn("taken", F.expr(_canonical("kind", "surrogate", "value")))
    real = staged(entities.select("kind", "value").distinct(), "entities")
    now = staged(draw(real.withColumn("attempt", F.lit(0))), "surrogates")
    while True:
        first = now.groupBy("kind", "taken").agg(F.min(F.struct("value", "attempt")).alias("first"), F.count(F.lit(1)).alias("n"))
        known = real.select("kind", F.col("value").alias("taken"), F.lit(True).alias("is_real"))
        bad = first.join(known, ["kind", "taken"], "left").filter("n > 1 OR is_real").select("kind", "taken", F.when(F.col("is_real"), F.lit(None)).otherwise(F.col("first.value")).alias("keeps"))
        if bad.isEmpty():
            return now.select("kind", "value", "surrogate")
        marked = now.join(bad.withColumn("clash", F.lit(True)), ["kind", "taken"], "left")
        again = F.coalesce(F.col("clash"), F.lit(False)) & ~F.col("value").eqNullSafe(F.col("keeps"))
        now = staged(draw(marked.select("kind", "value", (F.col("attempt") + again.cast("int")).alias("attempt"))), "surrogates")


def pseudonymise(docs: DataFrame, key: str, given: dict[str, list[str]] | None = None) -> DataFrame:
    """docs with surrogates in `text`, and `n_entities`, the mentions replaced in it. given: more given names, by gender (f, m, n)."""
    names = GIVEN | {("more", g): more for g, more in (given or {}).items()}
    pattern = _sql(_mention(names))
    mentions = f"transform(regexp_extract_all(row.text, {pattern}, 0), m -> struct(m AS m, {kind_of('m')} AS kind))"
    # Scanned once: every row is staged with its mentions, null if no entity is among them.
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("mentions", F.expr(mentions))
    found = staged(found.select("row", F.monotonically_increasing_id().alias("no"), F.expr("IF(exists(mentions, x -> x.kind IS NOT NULL), mentions, NULL)").alias("mentions")), "mentions")
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("text", "n_entities")]
    plain = found.filter("mentions IS NULL").select(*others, F.col("row.text").alias("text"), F.lit(0).cast("long").alias("n_entities"))
    rows = found.filter("mentions IS NOT NULL")
    each = rows.select("no", F.posexplode("mentions").alias("at", "x")).filter("x.kind IS NOT NULL").select("no", "at", F.col("x.m").alias("m"), F.col("x.kind").alias("kind")).withColumn("value", F.expr(value_of("m", "kind", names)))
    each = staged(each, "values")
    mapped = assign(each.select("kind", "value"), key)
    new = each.join(mapped, ["kind", "value"]).select("no", F.struct("at", F.expr(_rewritten("m", "kind", "value", "surrogate")).alias("new")).alias("x")).groupBy("no").agg(F.map_from_entries(F.collect_list("x")).alias("new"))
    text = F.expr(f"""array_join(transform(split(row.text, {pattern}, -1), (p, i) -> concat(p, IF(i < size(mentions), coalesce(new[i], mentions[i].m), ''))), '')""")
    changed = rows.join(new, "no").select(*others, text.alias("text"), F.size("new").cast("long").alias("n_entities"))
    return plain.unionByName(changed).select(*[f"`{c}`" for c in docs.columns if c != "n_entities"], "n_entities")
