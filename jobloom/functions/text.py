"""Text normalisation as columns: markup, dashes, white space, lines, script, sections, hashes, lenient values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SPACES, any_part, has, java, let, lowered, met, replace

HEAD_LINES = 10


def strip_html(text: Column) -> Column:
    """Markup to text: breaks, paragraphs and divisions to line breaks, list items to dashes, then scripts and styles out, other tags to spaces, six entities."""
    tags, entities = F.contains(text, F.lit("<")), lambda x: F.contains(x, F.lit("&"))
    whole = text
    for pattern, by in ((r"<\s*br\s*/?\s*>", "\n"), (r"<\s*/?p\s*>", "\n"), (r"<\s*/?div\s*>", "\n"), (r"<\s*/?li\s*>", "\n- "), (r"<\s*script[\s\S]*?<\s*/\s*script\s*>", ""), (r"<\s*style[\s\S]*?<\s*/\s*style\s*>", ""), (r"<[^>]+>", " ")):
        text = replace(text, pattern, by)
    return let(F.when(tags, text).otherwise(whole), lambda x: F.when(entities(x), _entities(x)).otherwise(x))


def _entities(text: Column) -> Column:
    for pattern, by in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = replace(text, pattern, by)
    return text


# Headers that get a line of their own when they follow other text.
GLUED_HEADERS = [
    "Что нам важно", "Что предстоит делать", "Мы предлагаем", "Задача", "Задачи", "Требования", "Обязанности", "Условия", "Контакты", "Как откликнуться", "Откликнуться", "Кто мы", "Кого мы ищем",
    "Кого мы ищем и почему", "Чем вы будете заниматься", "Ключевые навыки", "Хотите к нам", "О нас", "О позиции", "Responsibilities", "Requirements", "Benefits", "How to apply", "Apply",
]
# Latin letters that look like Cyrillic ones, where one starts a Cyrillic word.
LOOKALIKES = ("ABCEHKMOPTXYabcehkmoptxy", "АВСЕНКМОРТХУавсенкмортху")
# Words that are no company's name, alone or with the word that they are stuck to.
GLUE_WORDS = [
    "TypeScript", "Type Script", "JavaScript", "Java Script", "DevOps", "Dev Ops", "NestJS", "Nest JS", "NodeJS", "Node JS", "React", "Angular", "Vue", "Svelte", "NextJS", "NuxtJS", "Golang", "Go Lang", "Python", "Java",
    "Kotlin", "Swift", "Objective C", "iOS", "Android", "Flutter", "React Native", "Docker", "Kubernetes", "K8S", "AWS", "Azure", "GCP", "SQL", "NoSQL", "Data Science", "Machine Learning", "AI", "ML", "Linux",
    "Engineer", "Developer", "Manager", "Lead", "Architect", "Administrator", "Analyst", "Designer", "Product Manager", "Project Manager", "Scrum Master", "Recruiter", "HR", "Backend", "Front End", "Frontend",
    "Fullstack", "Full Stack", "Ops", "OTE", "JS", "TS", "QA", "PM", "PO", "UX", "UI", "BI", "SaaS", "DevSecOps", "Cloud",
]
# Tokens that aren't split.
WHOLE_TOKENS = ["B2B", "3D", "C4D", "iOS", "iPad", "iPhone", "macOS", "tvOS", "watchOS", "API", "URL", "HTTP", "HTTPS", "CSS", "HTML", "XML", "JSON", "PDF", "JPG", "PNG", "GIF", "SVG", "MP4", "AVI", "MOV"]
# A name that is stuck to what stands before it, what may stand before it, and what follows it.
STUCK_NAME, STUCK_END = r"([A-Z][A-Za-z0-9]{2,30})", r"(?=\s|$|,|:|LTD|LLC|INC|Corp|GmbH)"
STUCK_PLAIN = STUCK_END[: STUCK_END.index("|LTD")] + ")"
BEFORE_ANY, BEFORE_WORD = "A-Za-zА-Яа-яЁё0-9/&-", "[A-Z][a-z]+"
# Amounts that are stuck to a word.
AMOUNT_MARKED = r"([A-Za-zА-Яа-яЁё])(\d{2,3}(?:[ \t.,'’]\d{3})+\s*(?:₽|RUB|USD|EUR|GBP|CHF|\$|€|£))"
AMOUNT_GROUPED = r"([A-Za-zА-Яа-яЁё])(\d{1,3}(?:[ \t.,'’]\d{3})+(?:\s*(?:[-–—]|to)\s*\d{1,3}(?:[ \t.,'’]\d{3})+)?)"
# Posts of several vacancies, and footers, in order.
SEVERAL, VACANCY, BULLET = r"(?:^|\s)(?:две|2|two|several|multiple)\s+(?:ваканси|vacanc)", r"\bvacanc(?:y|ies)\b|ваканси", r"(?:^|\n)\s*[\-–—]\s+\S"
FOOTERS = [r"понравились\s+вакансии\?", r"-{3,}\s*разместить\s+вакансию", r"разместить\s+вакансию"]
FOOTER_AFTER = 200


def glue_blocked(token: Column) -> Column:
    """Whether a token is no name that could be stuck to a word: nothing, a single letter, or one of ``GLUE_WORDS``."""
    plain = F.lower(F.regexp_replace(token, java(r"[\s._\-+]", None), ""))
    words = list(dict.fromkeys(re.sub(r"[\s._\-+]", "", w).lower() for w in GLUE_WORDS))
    return (plain == "") | ((F.length(plain) <= 2) & ~F.rlike(plain, F.lit("^[a-z0-9]{2}$"))) | plain.isin(*words)


def _split_stuck(text: Column, before: str, start: str, end: str) -> Column:
    """``text`` with a space before each name that is stuck to ``before``, if both can stand alone.

    Matches are judged one by one: what lies between them and what they become is put together again.
    """
    pattern = java(f"{start}({before}){STUCK_NAME}{end}", fold=False)
    inside = java(f"^({before}){STUCK_NAME}$", fold=False)

    def judged(x: Column) -> Column:
        pair = F.struct(F.regexp_extract(x, inside, 1).alias("before"), F.regexp_extract(x, inside, 2).alias("name"))

        def apart(p: Column) -> Column:
            keep = F.lower(p["name"]).isin(*(w.lower() for w in WHOLE_TOKENS)) | glue_blocked(p["name"]) | glue_blocked(p["before"]) | glue_blocked(F.concat(p["before"], p["name"])) | (F.length(p["before"]) < 3)
            return F.when(keep, x).otherwise(F.concat(p["before"], F.lit(" "), p["name"]))

        return let(pair, apart)

    parts = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    joined = let(parts, lambda p: F.array_join(F.transform(p["gaps"], lambda gap, i: F.concat(gap, F.coalesce(judged(F.get(p["found"], i)), F.lit("")))), ""))
    return F.when(F.rlike(text, F.lit(pattern)), joined).otherwise(text)


def unglued(text: Column, end: str = STUCK_END) -> Column:
    """Names that are stuck to the word before them get a space: after any word, then between two words of one token.

    A name ends at ``end``; ``STUCK_PLAIN`` leaves out legal forms, which are also found inside of words (REINZUEINCH).
    """
    once = _split_stuck(text, f"[{BEFORE_ANY}]+", rf"(?:(?<![{BEFORE_ANY}])|\G)", end)  # a run is tried from its start alone
    may = F.rlike(text, F.lit(f"[A-Z](?<=[{BEFORE_ANY}][A-Z])[A-Za-z0-9]{{2}}"))  # a capital behind a letter: what both need
    return F.when(may, let(once, lambda x: _split_stuck(x, BEFORE_WORD, "", end))).otherwise(text)


def sanitized(text: Column) -> Column:
    """struct<text, warnings>: invisible separators to line breaks, look-alike letters, stuck words, amounts and names apart, headers and bullets on lines of their own, footers cut.

    Warnings: input_separator_normalized, multi_vacancy_post, input_truncated.  What concerns Cyrillic runs on texts
    that have any.
    """
    given = F.coalesce(text, F.lit(""))
    hidden = "\u200b\u200d\u2060\ufeff"
    cyrillic = [
        *((f"(?<![A-Za-zА-Яа-яЁё]){a}(?=[а-яё])", b) for a, b in zip(*LOOKALIKES)),
        (r"(?<=[а-яё])(?=[А-ЯЁ])", " "),
        (r"(?<=\p{IsCyrillic})(?=[A-Z])", " "),
        (r"(?<=[A-Za-z])(?=\p{IsCyrillic})", " "),
        (java(r"(?<=\p{IsCyrillic})от(?=\s+\d)", False), " от"),
    ]
    amounts = [(java(AMOUNT_MARKED, False), "$1 $2"), (java(AMOUNT_GROUPED, False), "$1 $2")]
    after_name = [(java(r"(-\p{IsCyrillic}{3,})в(\s+[A-ZА-ЯЁ])", False), "$1 в$2")]
    sentences = [(r"(?<=[.!?)\]])(?=[А-ЯЁ])", "\n")]
    lists = [
        (java(r"(:)\s*([-–—])\s*(?=\S)", False), "$1\n$2 "),
        (java(r"(@[A-Za-z0-9_]{3,})\s*([-–—])\s*(?=\S)", False), "$1\n$2 "),
        (java(rf"(?<=[^\n])(?=(?:{'|'.join(GLUED_HEADERS)})\s*[:-])", False), "\n"),
    ]

    def chain(out: Column, steps: list[tuple[str, str]]) -> Column:
        for pattern, by in steps:
            out = F.regexp_replace(out, pattern, by)
        return out

    # No step makes a text Cyrillic or makes amounts; headers are looked for where one stands.
    has_cyrillic = F.rlike(given, F.lit("[А-Яа-яЁё]"))
    plain = given
    for x in hidden:
        plain = F.replace(plain, F.lit(x), F.lit("\n"))
    amounted = lambda x: F.when(F.rlike(x, F.lit(r"\d[ \t.,'’]\d{3}")), chain(x, amounts)).otherwise(x)
    listed = lambda x: let(chain(x, lists[:2]), lambda y: F.when(any_part(y, shortest), chain(y, lists[2:])).otherwise(y))
    shortest = [x for x in GLUED_HEADERS if not any(y != x and y in x for y in GLUED_HEADERS)]

    def parted(cyr: Column) -> Column:
        apart = let(plain, lambda x: F.when(cyr, chain(let(chain(x, cyrillic), amounted), after_name)).otherwise(amounted(x)))
        whole = let(let(apart, unglued), lambda x: F.when(cyr, let(chain(x, sentences), listed)).otherwise(listed(x)))
        return F.struct(cyr.alias("cyrillic"), whole.alias("text"))

    def footed(parts: Column) -> Column:
        x = parts["text"]
        at = F.when(parts["cyrillic"], F.coalesce(*(F.nullif(F.regexp_instr(x, F.lit(java(p))), F.lit(0)) for p in FOOTERS)))
        several = let(lowered(x), lambda low: met(low, SEVERAL) | (met(low, VACANCY) & (F.regexp_count(x, F.lit(java(BULLET))) >= 2)))

        def cut(f: Column) -> Column:
            short = F.coalesce(f["at"] > FOOTER_AFTER + 1, F.lit(False))
            warned = F.array_compact(F.array(F.when(any_part(given, hidden), "input_separator_normalized"), F.when(f["several"], "multi_vacancy_post"), F.when(short, "input_truncated")))
            return F.struct(F.when(short, trim(F.substring(x, F.lit(1), f["at"] - 1))).otherwise(x).alias("text"), warned.alias("warnings"))

        return let(F.struct(at.alias("at"), several.alias("several")), cut)

    return let(let(has_cyrillic, parted), footed)


def trim(text: Column) -> Column:
    """Without white space at the ends, no-break spaces included."""
    return F.btrim(text, F.lit(SPACES))


def normalized(text: Column) -> Column:
    """Dashes and white space evened out: one kind of dash and line break, no tabs, no runs of spaces or blank lines."""
    text = F.translate(text, "–—", "--")
    for pattern, by in (("\r\n?", "\n"), ("\t", " "), (" {2,}", " "), ("\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, by)
    return trim(text)


def preprocessed(text: Column) -> Column:
    return normalized(strip_html(F.coalesce(text, F.lit(""))))


def lines(text: Column) -> Column:
    """The lines that aren't blank, trimmed."""
    return F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != "")


def head(all_lines: Column, n: int = HEAD_LINES) -> Column:
    return F.slice(all_lines, 1, n)


def detect_lang(text: Column) -> Column:
    """ru or en where at least four fifths of the Cyrillic and Latin letters are of that script, else mixed; unknown without any."""
    text = F.coalesce(text, F.lit(""))
    of = lambda letters: F.length(F.regexp_replace(text, f"[^{letters}]+", ""))

    def kind(n: Column) -> Column:
        ru, en = n["ru"], n["en"]
        return F.when(ru + en == 0, "unknown").when(ru / (ru + en) >= 0.8, "ru").when(en / (ru + en) >= 0.8, "en").otherwise("mixed")

    return let(F.struct(F.when(F.rlike(text, F.lit("[А-Яа-яЁё]")), of("А-Яа-яЁё")).otherwise(0).alias("ru"), of("A-Za-z").alias("en")), kind)


#: Section headers by section, in order of precedence (fixed values); each ends at an ASCII word boundary.
HEADERS = [
    ("requirements", "требования|требуемые|ожидания"),
    ("responsibilities", "обязанности|задачи|что делать"),
    ("benefits", "условия|мы предлагаем|бонусы"),
    ("contacts", "контакты|как откликнуться"),
    ("about", "о компании|о нас"),
    ("nice_to_have", "будет плюсом|плюсом будет|желательно"),
    ("requirements", "requirements|you have|your profile|what we are looking for|skills"),
    ("responsibilities", "responsibilities|what you will do|what you'll do|what you’ll do|your responsibilities|the role|what you will be doing"),
    ("benefits", "benefits|we offer|what we offer|compensation|perks|why join"),
    ("contacts", "contacts|how to apply|apply|apply now|contact"),
    ("about", "about|about us|company|who we are"),
    ("nice_to_have", "nice to have|optional|preferred|plus"),
    ("requirements", "anforderungen|qualifikationen|profil"),
    ("responsibilities", "aufgaben|verantwortlichkeiten"),
    ("benefits", "wir bieten|angebot"),
    ("contacts", "kontakt|bewerbung|bewerben"),
    ("about", "über uns|unternehmen"),
    ("nice_to_have", "von vorteil|wünschenswert"),
    ("requirements", "exigences|compétences"),
    ("responsibilities", "responsabilités|missions"),
    ("benefits", "avantages|nous offrons"),
    ("contacts", "candidature|postuler"),
    ("about", "à propos|à propos de nous"),
    ("nice_to_have", "souhaité|optionnel|atout"),
    ("requirements", "requisitos|perfil"),
    ("responsibilities", "responsabilidades|tareas"),
    ("benefits", "ofrecemos|beneficios"),
    ("contacts", "contacto|cómo aplicar|aplicar"),
    ("about", "sobre nosotros|empresa"),
    ("nice_to_have", "deseable|se valora"),
    ("requirements", "requisiti|profilo"),
    ("responsibilities", "responsabilità|mansioni"),
    ("benefits", "offriamo|benefici"),
    ("contacts", "contatti|candidati|candidatura"),
    ("about", "chi siamo|azienda"),
    ("nice_to_have", "preferibile"),
    ("responsibilities", "atribuições"),
    ("benefits", "oferecemos|benefícios"),
    ("contacts", "contato|candidatar"),
    ("about", "sobre nós"),
    ("nice_to_have", "desejável"),
]


def header_of(line: Column) -> Column:
    """The section that a line opens, or null: of the headers that it starts with the first in order."""
    section: dict[str, str] = {}
    for name, words in HEADERS:
        for w in words.split("|"):
            section.setdefault(w, name)
    names = F.create_map(*(F.lit(x) for pair in section.items() for x in pair))
    return F.try_element_at(names, F.lower(F.regexp_extract(line, java("^(" + "|".join(section) + r")\b"), 1)))


def _opened(line: Column) -> Column:
    """(section, remainder) of a header line: what stands before a colon, or the whole line without colons and dashes at its end."""
    at = F.instr(line, ":")
    before = F.when(at > 1, header_of(trim(F.substring(line, F.lit(1), at - 1))))
    whole = header_of(F.regexp_replace(line, r"[:\-]+\s*$", ""))
    rest = F.when(before.isNotNull(), trim(F.substring(line, at + 1, F.length(line)))).otherwise("")
    return F.struct(F.coalesce(before, whole).alias("name"), rest.alias("rest"))


def sections(all_lines: Column) -> Column:
    """array<struct<name, lines>>: the head (first ten lines), then runs of lines under the last header seen; empty runs left out."""
    marked = F.transform(all_lines, lambda x: F.struct(_opened(x).alias("h"), x.alias("line")))
    kind = "array<struct<name:string,lines:array<string>>>"
    start = F.array(F.struct(F.lit("body").alias("name"), F.array().cast("array<string>").alias("lines"))).cast(kind)

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        opened = F.array(F.struct(x["h"]["name"].alias("name"), F.filter(F.array(x["h"]["rest"]), lambda r: r != "").alias("lines"))).cast(kind)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["name"].alias("name"), F.concat(last["lines"], F.array(x["line"])).alias("lines"))).cast(kind))
        return F.when(x["h"]["name"].isNotNull(), F.concat(done, opened)).otherwise(longer)

    body = F.aggregate(marked, start, step)
    top = F.array(F.struct(F.lit("head").alias("name"), head(all_lines).alias("lines"))).cast(kind)
    return F.filter(F.concat(top, body), lambda s: F.size(s["lines"]) > 0)


def text_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, joined by ``|``."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def item_hash(*parts: Column) -> Column:
    """The first 16 digits of that."""
    return F.substring(text_hash(*parts), 1, 16)


def first_line_title(text: Column, size: int = 120) -> Column:
    """The first line that isn't blank, without emoji, cut to ``size`` characters."""
    plain = F.regexp_replace(F.element_at(F.concat(lines(F.coalesce(text, F.lit(""))), F.array(F.lit(""))), 1), "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}]", "")
    return F.substring(trim(plain), 1, size)


def parse_count(text: Column) -> Column:
    """12.5K, 3 млн, 1 200 -> a number; null if there is none."""
    low = F.lower(text)
    number = F.regexp_replace(F.regexp_replace(F.regexp_extract(low, r"(\d[\d .,]*)", 1), r"[ ]", ""), ",", ".").cast("double")
    unit = F.when(has(low, r"\d\s*(?:m|млн)"), 1_000_000).when(has(low, r"\d\s*(?:k|к|тыс)"), 1_000).otherwise(1)
    return F.floor(number * unit + 0.5)


def parse_date(text: Column) -> Column:
    """Epoch seconds (up to ten digits) or milliseconds, or an ISO date with a blank or T, UTC where it names no zone."""
    digits = F.regexp_extract(text, r"^\d+$", 0)
    epoch = F.when(digits != "", F.when(F.length(digits) <= 10, F.timestamp_seconds(digits.cast("bigint"))).otherwise(F.timestamp_millis(digits.cast("bigint"))))
    return F.coalesce(epoch, F.try_to_timestamp(F.when(digits == "", F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2})", "$1T$2"))))


def compact_money(x: Column) -> Column:
    """1200 -> 1.2K, 3000000 -> 3M."""
    short = lambda v, unit: F.concat(F.regexp_replace(F.format_string("%.1f", v), r"\.0$", ""), F.lit(unit))
    return F.when(x >= 1_000_000, short(x / 1_000_000, "M")).when(x >= 1_000, short(x / 1_000, "K")).otherwise(F.format_string("%.0f", x.cast("double")))


# How periods are shown, and what tells a text's language, in order.
PERIODS = {"hour": " /час", "day": " /день", "week": " /нед", "month": " /мес", "year": " /год", "project": " /проект"}
LETTERS = [("ru", "[А-Яа-яЁё]"), ("de", "[ÄÖÜäöüß]"), ("fr", "[éèêàçùâîôûëïüÿœæÉÈÊÀÇÙÂÎÔÛËÏÜŸŒÆ]"), ("es", "[ñáéíóúüÑÁÉÍÓÚÜ¡¿]"), ("pl", "[ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]"), ("it", "[ìíîïòóôõùúûüÌÍÎÏÒÓÔÕÙÚÛÜ]"), ("ro", "[ăâîșțĂÂÎȘȚ]")]


def shown_salary(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """1200, 3000, EUR, month -> 1.2K–3K EUR; a month isn't named for amounts in thousands, a dash stands for none."""
    least, most = F.coalesce(low, high), F.coalesce(high, low)
    amount = F.when(least != most, F.concat(compact_money(least), F.lit("–"), compact_money(most))).otherwise(compact_money(least))
    unit = F.concat(F.lit(" "), F.when(~currency.isin("", "UNKNOWN"), currency))
    names = F.create_map(*(F.lit(x) for kv in PERIODS.items() for x in kv))
    skip = ((least >= 1000) | (most >= 1000)) & (period == "month")
    return F.when(least.isNull(), "—").otherwise(F.concat(amount, F.coalesce(unit, F.lit("")), F.when(F.coalesce(skip, F.lit(False)), "").otherwise(F.coalesce(F.try_element_at(names, period), F.lit("")))))


def short_title(title: Column, words: int = 3) -> Column:
    """The first words of a title."""
    return F.array_join(F.slice(F.split(trim(F.coalesce(title, F.lit(""))), r"\s+"), 1, words), " ")


def short_text(text: Column, least: int = 20) -> Column:
    """A tenth of a text, at least ``least`` characters, with dots if something is left out."""
    whole = trim(F.coalesce(text, F.lit("")))
    size = F.greatest(F.lit(least), F.floor(F.length(whole) / 10)).cast("int")
    return F.when(F.length(whole) <= size, whole).otherwise(F.concat(F.substring(whole, F.lit(1), size), F.lit("...")))


def source_language(text: Column, size: int = 500) -> Column:
    """The language that a text's first characters hint at by script and accents; en without a hint."""
    sample, out = F.substring(text, 1, size), F.lit("en")
    for name, letters in reversed(LETTERS):
        out = F.when(F.rlike(sample, F.lit(letters)), name).otherwise(out)
    return out


def by_locale(value: Column) -> Column:
    """A key to sort by as readers do: base letters count, accents and case don't, null is an empty text."""
    return F.collate(F.coalesce(value, F.lit("")), "UNICODE_CI_AI")


def locale_sorted(values: Column) -> Column:
    """The distinct values in the order of letters, then accents, then case, whatever their script."""
    ordered = F.array_sort(F.transform(F.array_distinct(values), lambda x: F.collate(x, "UNICODE")))
    return F.transform(ordered, lambda x: F.collate(x, "UTF8_BINARY"))
