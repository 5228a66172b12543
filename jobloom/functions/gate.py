"""Which postings are vacancies, and which rows are anomalies."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import first, has, let, likely, sql_has

# The words that the gate looks for.  ``\b`` is the ASCII boundary, so Cyrillic alternatives inside ``\b(...)`` match only next to ASCII word characters.
VACANCY = r"\b(ваканси|позици|ищем|требуетс|нанимаем|hiring|vacancy|job\s+opening|open\s+position|we\s+are\s+looking\s+for|looking\s+for)\b"
UNAVAILABLE = r"(stellenangebot\s+(gibt\s+es\s+nicht\s+mehr|nicht\s+oder\s+nicht\s+mehr|nicht\s+mehr\s+verfügbar)|job\s+(ist\s+)?nicht\s+mehr\s+verfügbar)"
APPLY = r"(\b(отклик|откликнутьс|apply|how\s+to\s+apply|send\s+(?:cv|resume)|tg:|telegram)\b|@[a-z0-9_]{3,}|\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b)"
SECTIONS = r"\b(требовани|обязанност|услови|responsibilities|requirements|benefits)\b"
RESUME_TITLE = r"^(резюме|cv|resume)\b"
RESUME_WORD = r"\b(резюме|cv|resume)\b"
RESUME_TAG = r"#\s*(резюме|cv|resume)"
INTRO = r"\b(всем\s+привет|hi\s+all|hello\s+everyone|привет\s+всем|меня\s+зовут|моё\s+имя|мое\s+имя|my\s+name\s+is)\b"
FIRST_PERSON = r"\bя\s+[а-яё0-9a-z][\w\s-]{0,30}?\s*(developer|engineer|designer|generalist|artist|cg|vfx|motion|3d)\b"
SEEKING = r"\b(ищу\s+работу|ищу\s+позицию|looking\s+for\s+work|seeking\s+position|seeking\s+opportunity|open\s+to\s+opportunities|готов\s+рассмотреть|готов\s+к\s+работе|готов\s+к\s+релокации|relocation\s+ready|готов\s+к\s+переезду)\b"
STRUCTURE = r"\b(опыт\s+работы|образование|мои\s+навыки|my\s+skills|портфолио|portfolio|готов\s+к\s+собеседованию|готов\s+к\s+интервью|готов\s+к\s+стажировке|готов\s+к\s+стажу)\b"
SALARY = r"(\b\d{1,3}(?:[ \t.,'’]\d{3})+\b|\b\d{2,}\s*(?:₽|\$|€|usd|eur|rub|gbp|k|тыс)\b)"
ROLE = r"\b(developer|engineer|designer|manager|analyst|recruiter|qa|devops|product|backend|frontend|fullstack|дизайнер|разработчик|менеджер|аналитик|рекрутер|тестировщик|девопс|маркетолог|копирайтер)\b"
PROMO = r"\b(спецпредложен|акци[яи]|скидк|промокод|вебинар|эфир|курс|марафон|челлендж|подборк|папк[ау]\s+с\s+telegram|папк[ау]\b|канал(ы|ов)?|подписчик|поздравля|новост|налогов|бот\b|чат-бот|воркшоп)\b"
RESUME_TEXT = r"(#\s*(резюме|cv|resume)|\b(всем\s+привет|привет\s+всем|hello\s+everyone|hi\s+all)\b|\b(меня\s+зовут|my\s+name\s+is)\b|\b(ищу\s+работу|ищу\s+позицию|looking\s+for\s+work|seeking\s+position|open\s+to\s+opportunities)\b)"
FAKE_PLACE = r"\b(java|oop)\b"
LOW_SALARY = r"(\d{2,4})\s*(eur|usd|gbp|chf|aud|cad|pln|czk|uah|kzt|byn|rub|rur|₽|\$|€|£)"
GONE = ("stellenangebot gibt es nicht", "nicht mehr verfügbar", "job existiert nicht mehr")
#: Plain text that a match of a pattern needs, where its alternatives don't begin with it.
SIGNS = {"apply": ["отклик", "apply", "send", "tg:", "telegram", "@"], "salary": list("0123456789"), "person": ["developer", "engineer", "designer", "generalist", "artist", "cg", "vfx", "motion", "3d"]}
#: Source types that the group ``api`` stands for.
API_SOURCES = [
    "arbeitsagentur",
    "arbeitnow",
    "remotive",
    "remoteok",
    "jobicy",
    "findwork",
    "devitjobs",
    "themuse",
    "theirstack",
    "fantasticjobs",
    "jobdata",
    "techmap",
    "okjob",
    "whatjobs",
    "usajobs",
    "jobs2careers",
    "graphqljobs",
]
CHALLENGE = ("just a moment", "checking your browser", "enable javascript and cookies", "attention required", "cf-challenge", "captcha")
#: The same of a payload that begins as an HTML page.
HTML_CHALLENGE = ("request unsuccessful", "incapsula", "access denied", "verification required", "enable javascript", "cloudflare")


def vacancy_reason(title: Column, description: Column, tags: Column | None = None, link: Column | None = None) -> Column:
    """Why a posting is no vacancy, or ``ok``: hard negatives first, then a score of cues.

    Each cue is looked for once, behind a search for the plain words that it needs.
    """
    empty = F.lit("")
    title, description = F.trim(F.coalesce(title, empty)), F.trim(F.coalesce(description, empty))
    text = F.lower(F.concat_ws("\n", title, description, F.trim(F.coalesce(tags, empty)) if tags is not None else empty, F.trim(F.coalesce(link, empty)) if link is not None else empty))
    patterns = {"vacancy": VACANCY, "apply": APPLY, "sections": SECTIONS, "role": ROLE, "promo": PROMO, "salary": SALARY, "word": RESUME_WORD, "tag": RESUME_TAG, "seeking": SEEKING, "structure": STRUCTURE, "intro": INTRO, "person": FIRST_PERSON, "gone": UNAVAILABLE}
    flags = lambda t: F.struct(*(likely(t, p, SIGNS.get(name)).alias(name) for name, p in patterns.items()))

    def reason(f: Column) -> Column:
        resume = has(title, RESUME_TITLE) | (~f["vacancy"] & (f["word"] | f["tag"] | f["seeking"] | (f["structure"] & ~f["apply"] & ~f["sections"]) | ((f["intro"] | f["person"]) & ~f["apply"])))
        score = 2 * f["vacancy"].cast("int") + sum((f[k].cast("int") for k in ("apply", "sections", "salary", "role")), F.lit(0)) - 3 * f["promo"].cast("int")
        return (
            F.when(f["gone"], "job_unavailable_page")
            .when(resume, "resume_post")
            .when(f["promo"] & (score <= 0), "promo_or_news")
            .when(~f["vacancy"] & ~f["role"] & ~f["sections"] & ~f["salary"] & ~f["apply"], "no_vacancy_signals")  # without these two the other cues outweigh no promotion, so this is score <= 0
            .otherwise("ok")
        )

    return F.when(description == "", "empty_description").when((F.length(description) < 40) & (F.lower(title) == "вакансия"), "too_short_generic").otherwise(let(text, lambda t: let(flags(t), reason)))


def sql_vacancy_reason(title: str, description: str) -> str:
    """The same in DuckDB, for rows without tags or link; ``title`` and ``description`` are trimmed and not null."""
    text = f"lower({title} || chr(10) || {description} || chr(10) || chr(10))"
    h = lambda p: sql_has(text, p)
    resume = f"({sql_has(title, RESUME_TITLE)} OR (NOT {h(VACANCY)} AND ({h(RESUME_WORD)} OR {h(RESUME_TAG)} OR {h(SEEKING)} OR ({h(STRUCTURE)} AND NOT {h(APPLY)} AND NOT {h(SECTIONS)}) OR (({h(INTRO)} OR {h(FIRST_PERSON)}) AND NOT {h(APPLY)}))))"
    n = lambda p: f"CAST({h(p)} AS INT)"
    score = f"(2 * {n(VACANCY)} + {n(APPLY)} + {n(SECTIONS)} + {n(SALARY)} + {n(ROLE)} - 3 * {n(PROMO)})"
    return f"CASE WHEN {description} = '' THEN 'empty_description' WHEN length({description}) < 40 AND lower({title}) = 'вакансия' THEN 'too_short_generic' WHEN {h(UNAVAILABLE)} THEN 'job_unavailable_page' WHEN {resume} THEN 'resume_post' WHEN {h(PROMO)} AND {score} <= 0 THEN 'promo_or_news' WHEN NOT {h(VACANCY)} AND NOT {h(ROLE)} AND {score} <= 0 THEN 'no_vacancy_signals' ELSE 'ok' END"


def anomaly_reasons(text: Column, location: Column, content: Column) -> Column:
    """array<string>: resume, fake_location, low_salary (the first amount of 2 to 4 digits before a currency is under 500), too_short."""
    size = F.length(F.trim(content))
    low = first(F.lower(text), LOW_SALARY, 1).cast("int") < 500
    hit = lambda c, name: F.when(F.coalesce(c, F.lit(False)), name)
    return F.array_compact(F.array(hit(has(F.lower(text), RESUME_TEXT, fold=False), "resume"), hit(has(F.lower(location), FAKE_PLACE, fold=False), "fake_location"), hit(low, "low_salary"), hit((size > 0) & (size < 150), "too_short")))


def needs_full_text(text: Column, least: int = 400) -> Column:
    """A description that is short, or not long and full of links."""
    size = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return (size < least) | ((size < 2 * least) & F.coalesce(has(text, r"https?://"), F.lit(False)))


def snippet_needs_text(snippet: Column, least: int = 400) -> Column:
    """A feed's snippet that is short, links on or asks for a click."""
    plain = F.coalesce(snippet, F.lit(""))
    return (F.length(plain) < least) | has(plain, r"https?://") | has(plain, r"\b(click\s+here|apply\s+now|read\s+more)\b")


def record_needs_text(raw: Column, description: Column, least: int = 400) -> Column:
    """A stored record without raw text or with less than half of ``least``, or with a description under ``least``."""
    raw, description = F.coalesce(raw, F.lit("")), F.coalesce(description, F.lit(""))
    return (F.trim(raw) == "") | (F.length(raw) < least / 2) | (F.trim(description) == "") | (F.length(description) < least)


def challenge_page(html: Column) -> Column:
    low = F.lower(F.coalesce(html, F.lit("")))
    said = lambda phrases: reduce(or_, (low.contains(p) for p in phrases))
    return said(CHALLENGE) | (F.rlike(low, F.lit(r"^[\s\uFEFF]*<(?:!doctype html|html)")) & said(HTML_CHALLENGE))


def unavailable(*texts: Column) -> Column:
    """A text that says the posting is gone, case-insensitively."""
    out = F.lit(False)
    for t in texts:
        for phrase in GONE:
            out = out | F.coalesce(F.contains(F.lower(t), F.lit(phrase)), F.lit(False))
    return out


def of_source(kind: Column, wanted: str | None) -> Column:
    """Whether a source type is the wanted one; ``api`` is a group of types, none is all."""
    return F.lit(True) if not wanted else kind.isin(*API_SOURCES) if wanted == "api" else F.coalesce(kind == wanted, F.lit(False))
