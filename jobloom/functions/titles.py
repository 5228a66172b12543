"""Title of a posting: candidates from its first lines, cleaned and scored; role, level and technologies of the best.

Candidates are the first two lines, lines in capitals and what follows a phrase like "Position:".  A candidate that
stands twice counts once, the first time; of equal scores the first wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import tech_names
from .patterns import any_part, first, has, let, lowered, met, replace

# The kinds of title in order of precedence and the patterns, any case, that name them.
ROLES = [
    ("frontend_developer", r"(front\s*-?end|frontend|фронт\s*-?енд|фронтенд|angular\s+developer|react\s+developer|vue\s+developer|vue\.js|ember|svelte|next\.js|nuxt|gatsby|web\s+developer|javascript\s+developer|typescript\s+developer|js\s+developer|ts\s+developer|front[-\s]?end\s+engineer|front[-\s]?end\s+programmer|front[-\s]?end\s+specialist)"),
    ("backend_developer", r"(back\s*-?end|backend|бэк\s*-?енд|бэкенд|server\s*-?side|node\.js\s+developer|nestjs\s+developer|java\s+developer|golang\s+developer|go\s+developer|python\s+developer|php\s+developer|\.net\s+developer|dotnet\s+developer|c#\s+developer|c\+\+\s+developer|rust\s+developer|ruby\s+developer|ruby\s+on\s+rails|scala\s+developer|erlang\s+developer|elixir\s+developer|clojure\s+developer|haskell\s+developer|perl\s+developer|lua\s+developer|back[-\s]?end\s+engineer|back[-\s]?end\s+programmer|back[-\s]?end\s+specialist|server[-\s]?side\s+developer|server[-\s]?side\s+engineer)"),
    ("fullstack_developer", r"(full\s*-?stack|fullstack|фулл\s*-?стек|фуллстек|full\s+stack)"),
    ("mobile_developer", r"(mobile\s+developer|мобильн\w+\s+разработчик|mobile\s+app\s+developer|flutter\s+developer|react\s+native\s+developer|xamarin\s+developer)"),
    ("ios_developer", r"(ios\s+developer|swift\s+developer|objective[-\s]?c\s+developer|ios\s+app\s+developer|apple\s+developer)"),
    ("android_developer", r"(android\s+developer|kotlin\s+developer|android\s+app\s+developer)"),
    ("qa_engineer", r"(qa\b|quality\s+assurance|тестировщик|qa\s+engineer|test\s+engineer|testing\s+engineer|quality\s+engineer|test\s+specialist|qa\s+specialist)"),
    ("automation_qa", r"(automation\s+qa|qa\s+automation|автоматизац\w+\s+тестирован|test\s+automation|automated\s+testing|selenium|cypress|playwright|test\s+automation\s+engineer)"),
    ("manual_qa", r"(manual\s+qa|ручн\w+\s+тестирован|manual\s+testing|manual\s+tester)"),
    ("devops_engineer", r"(devops|девопс|dev\s+ops|infrastructure\s+engineer|platform\s+engineer|cloud\s+engineer|aws\s+engineer|azure\s+engineer|gcp\s+engineer|kubernetes\s+engineer|docker\s+engineer|terraform\s+engineer|ansible\s+engineer)"),
    ("sre", r"(\bsre\b|site\s+reliability|site\s+reliability\s+engineer|reliability\s+engineer)"),
    ("data_engineer", r"(data\s+engineer|инженер\w+\s+данных|etl\s+developer|data\s+warehouse\s+engineer|big\s+data\s+engineer|spark\s+engineer|hadoop\s+engineer|data\s+pipeline\s+engineer|data\s+infrastructure\s+engineer|data\s+platform\s+engineer)"),
    ("data_scientist", r"(data\s+scientist|дата\s+саентист|аналитик\w+\s+данных|data\s+analyst|data\s+science|machine\s+learning\s+scientist|research\s+scientist|data\s+researcher|statistical\s+analyst|quantitative\s+analyst)"),
    ("ml_engineer", r"(ml\s+engineer|machine\s+learning\s+engineer|инженер\w+\s+машинного\s+обучения|ai\s+engineer|deep\s+learning\s+engineer|neural\s+network\s+engineer|computer\s+vision\s+engineer|nlp\s+engineer|natural\s+language\s+processing)"),
    ("product_manager", r"(product\s+manager|продакт\s+менеджер|менеджер\s+продукта|product\s+owner|\bpo\b|product\s+lead|head\s+of\s+product|vp\s+product|director\s+of\s+product)"),
    ("project_manager", r"(project\s+manager|pm\b|проектн\w+\s+менеджер|program\s+manager|delivery\s+manager|implementation\s+manager)"),
    ("business_analyst", r"(business\s+analyst|бизнес\s*-?аналитик|ba\b|business\s+intelligence|bi\s+analyst|business\s+intelligence\s+analyst|financial\s+analyst|finance\s+analyst|data\s+analyst|analyst)"),
    ("system_analyst", r"(system\s+analyst|системн\w+\s*-?аналитик|systems\s+analyst|it\s+analyst|technical\s+analyst)"),
    ("ux_ui_designer", r"(ux\s*\/\s*ui|ux\b|ui\b|ux\s+designer|ui\s+designer|web\s*designer|веб-?дизайнер|дизайнер\w+\s+интерфейсов|user\s+experience|user\s+interface|interaction\s+designer|ux\s+researcher|ui\s+ux)"),
    ("product_designer", r"(product\s+designer|product\s+дизайнер|продуктов\w+\s+дизайнер|digital\s+product\s+designer)"),
    ("graphic_designer", r"(graphic\s+designer|графическ\w+\s+дизайнер|motion\s+designer|3d\s+designer|3d\s+motion\s+designer|3d-?аниматор|3d\s+аниматор|моушн\s+дизайнер|visual\s+designer|brand\s+designer|logo\s+designer|illustrator|animator|2d\s+animator|3d\s+animator|дизайнер|designer)"),
    ("support_engineer", r"(support\s+engineer|техподдержк\w+|support|technical\s+support|customer\s+support|it\s+support|help\s+desk|support\s+specialist|support\s+analyst)"),
    ("security_engineer", r"(security\s+engineer|инженер\w+\s+безопасности|infosec|cybersecurity|cyber\s+security|information\s+security|security\s+specialist|penetration\s+tester|security\s+analyst|security\s+architect)"),
    ("solutions_architect", r"(solutions\s+architect|solution\s+architect|enterprise\s+architect|system\s+architect|technical\s+architect|cloud\s+architect|software\s+architect)"),
    ("architect", r"(\barchitect\b|архитектор|software\s+architect|system\s+architect)"),
    ("cto", r"(\bcto\b|chief\s+technology\s+officer|chief\s+technical\s+officer|техническ\w+\s+директор)"),
    ("team_lead", r"(team\s+lead|тимлид|teamlead|team\s+leader|development\s+lead|engineering\s+lead)"),
    ("tech_lead", r"(tech\s+lead|техлид|techlead|technical\s+lead|engineering\s+lead|senior\s+engineer)"),
    ("scrum_master", r"(scrum\s+master|скрам\s+мастер|agile\s+coach|scrum\s+coach)"),
    ("hr_recruiter", r"(recruiter|talent\s+acquisition|hr\s+manager|рекрутер|talent\s+acquisition\s+specialist|technical\s+recruiter|it\s+recruiter|headhunter|talent\s+sourcer|sourcer|hr\s+specialist|hr\s+business\s+partner|people\s+operations)"),
    ("sales_manager", r"(sales\s+manager|account\s+executive|account\s+manager|business\s+development|sales\b|sales\s+representative|sales\s+executive|sales\s+director|sales\s+lead|bd\s+manager|business\s+development\s+manager|key\s+account\s+manager|inside\s+sales|outside\s+sales|sales\s+engineer|presales)"),
    ("marketing_manager", r"(marketing\s+manager|digital\s+marketing|performance\s+marketing|growth\s+marketer|marketing\b|marketing\s+specialist|marketing\s+director|marketing\s+lead|growth\s+hacker|growth\s+manager|brand\s+manager|product\s+marketing|seo\s+specialist|seo\s+manager|ppc\s+specialist|ppc\s+manager|sem\s+specialist|smm\s+manager|social\s+media\s+manager|social\s+media\s+marketing|email\s+marketing|affiliate\s+manager|traffic\s+manager|media\s+buyer|performance\s+marketer)"),
    ("content_manager", r"(content\s+manager|content\s+specialist|content\b|content\s+marketing|content\s+strategist|content\s+creator|content\s+writer|editor|copywriter|копирайтер|blogger|content\s+editor|editorial\s+manager)"),
    ("copywriter", r"(copywriter|content\s+writer|writer\b|копирайтер|technical\s+writer|documentation\s+specialist|content\s+creator)"),
    ("accountant", r"(accountant|bookkeeper|бухгалтер|financial\s+accountant|management\s+accountant|cost\s+accountant|tax\s+accountant|auditor|internal\s+auditor|external\s+auditor|financial\s+controller|finance\s+manager|treasurer)"),
    ("lawyer", r"(lawyer|legal\s+counsel|юрист|attorney|legal\s+advisor|legal\s+specialist|corporate\s+lawyer|contract\s+lawyer|ip\s+lawyer|labor\s+lawyer|paralegal|legal\s+assistant|compliance\s+officer|compliance\s+manager|regulatory\s+affairs)"),
]
LEVELS = [("intern", r"(intern|стаж[её]р|стажировк)"), ("junior", r"(junior|\bjr\b|джун)"), ("middle", r"(middle|mid\b|мидл?)"), ("senior", r"(senior|\bsr\b|сеньор|старш(ий|ая))"), ("lead", r"(lead|лид|руководител)"), ("principal", r"(principal|staff)")]
PHRASES = r"^\s*(?:(?:вакансия|позиция|position|vacancy|role)\s*[:\-]|we\s+are\s+looking\s+for(?:\s+an?)?|we\s+need(?:\s+an?)?|looking\s+for(?:\s+an?)?|(?:мы\s+)?ищем|требу[ею]тс[яь]|требуются|нужен|нужна|нужны)\s+(.+)$"
SECTION_WORD = r"\b(requirements|responsibilities|обязанности|требования)\b"
#: What a title doesn't hold: the posting's other fields.
AFTER = r"(\s+[|•·]\s.*|\s+(?:-|–|—)\s+(?:remote|hybrid|удал[её]н|full[- ]time|part[- ]time|от\s+\d|\$|€|\d).*|\s*[,(]?\s*(?:от|до|from|up\s+to)\s+(?:[$€£]\s*\d|\d[\d\s.,]*(?:k|тыс|руб|₽|[$€]|usd|eur|rub)).*|\s+(?:компания|company|локация|location|зарплата|salary)\s*:.*)$"


# How lines begin that are no candidates at all.
NO_LINE = r"^(описание\s+(?:вакансии|стажировки)\s*:|(source|источник|канал|channel)\s*[:\-]|последн(ее|яя)\s+спецпредложение|анонсируем\s+акцию|акци[яи]\b|промокод\b)"


def cleaned(line: Column) -> Column:
    """A line without marks, tags, labels and what follows a title; empty if nothing is left."""
    out = F.regexp_replace(line, "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}*_`]", "")
    out = let(out, lambda x: F.when(F.contains(x, F.lit("#")), replace(x, r"#\S+", " ")).otherwise(x))
    for pattern, by in ((r"^[^A-Za-zÀ-ÿА-Яа-яЁё.(0-9]+", ""), (r"^(?:вакансия|позиция|должность|position|vacancy|job\s+title|title|role)\s*[:\-]\s*", ""), (r"^(?:ищем|мы\s+ищем|требуется|нужен|нужна|нужны|we\s+are\s+looking\s+for|looking\s+for|hiring)\s*:?\s+(?:an?\s+)?", "")):
        out = replace(out, pattern, by)
    out = _without_rest(out)
    for pattern, by in ((r"\s+", " "), (r"[\s,:;-]+$", "")):
        out = replace(out, pattern, by)
    return let(F.trim(out), lambda x: F.when(has(x, NO_LINE), "").otherwise(x))


def _without_rest(line: Column) -> Column:
    """A line up to ``AFTER``, which is looked for where its signs stand: it needs a bar, a digit, a dash or a colon behind or before such words."""

    def may(low: Column) -> Column:
        dashed = any_part(low, "-–—") & any_part(low, ["remote", "hybrid", "удал", "full", "part", "$", "€"])
        return any_part(low, "|•·") | F.rlike(low, F.lit(r"\d")) | dashed | (F.contains(low, F.lit(":")) & any_part(low, ["компания", "company", "локация", "location", "зарплата", "salary"]))

    return let(line, lambda x: F.when(let(lowered(x), may), replace(x, AFTER, "")).otherwise(x))


# Lines that are no titles: of a feed, of sections, of pay, and words of format and time that don't make one.
FEED_LINE = r"^(source|источник|канал|channel)\s*[:\-]"
NO_TITLE = r"(\b(requirements|responsibilities|обязанности|требования|кто\s+мы|кого\s+мы\s+ищем|ключевые\s+навыки)\b|https?://|\d{2,}\s*(?:₽|\$|€|usd|eur|rub|k|тыс))"
FORMAT_WORDS = r"(удал[её]н[а-яё]*|remote(ly)?|hybrid|on[-\s]*site|office|в\s+офисе|офис|part[-\s]*time|full[-\s]*time|парт[-\s]*тайм|фулл[-\s]*тайм|(частичн|полн)[а-яё]*\s+занятост[а-яё]*)"


def plausible(title: Column) -> Column:
    """Whether a text can be a title: not too long, with letters beside words of format and time, no line of a feed, section, pay or link."""
    return (F.length(title) <= 140) & F.rlike(replace(title, FORMAT_WORDS, " "), F.lit("[A-Za-zА-Яа-яЁё]")) & ~has(title, FEED_LINE) & ~has(title, NO_TITLE)


def kind(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The first of the rules that a text meets, or ``unknown``."""

    def of(low: Column) -> Column:
        out = F.lit("unknown")
        for name, p in reversed(rules):
            out = F.when(met(low, p), name).otherwise(out)
        return out

    return let(lowered(text), of)


def logistic(score: Column, k: float, middle: float) -> Column:
    return 1 / (1 + F.exp(-k * (score - middle)))


def title(lines: Column, strict: bool = False) -> Column:
    """struct<value, role, level, specialization, raw, confidence, warnings> from a posting's first lines."""
    lined = F.transform(F.slice(lines, 1, 10), lambda x, i: F.struct(i.alias("i"), cleaned(x).alias("text"), first(x, PHRASES, 1).alias("tail")))
    one = lambda x, kind, score, text: F.struct(F.lit(kind).alias("kind"), x["i"].alias("i"), F.lit(score).alias("base"), text.alias("text"))
    caps = lambda base: F.filter(base, lambda x: F.rlike(x["text"], F.lit(r"\p{Lu}{2}")) & ~F.rlike(x["text"], F.lit(r"\p{Ll}")))
    candidates = lambda base: F.concat(
        F.transform(F.filter(base, lambda x: x["i"] < 2), lambda x: one(x, 0, 2, x["text"])),
        F.transform(caps(base), lambda x: one(x, 1, 2, x["text"])),
        F.transform(F.filter(base, lambda x: x["tail"].isNotNull()), lambda x: one(x, 2, 3, cleaned(x["tail"]))),
    )

    def scored(c: Column) -> Column:
        facts = F.struct(kind(c["text"], ROLES).alias("role"), kind(c["text"], LEVELS).alias("level"), tech_names(c["text"]).alias("names"), plausible(c["text"]).alias("fits"), has(c["text"], SECTION_WORD).alias("section"))

        def sum_(f: Column) -> Column:
            score = c["base"] + f["fits"].cast("int") - (F.length(c["text"]) > 90).cast("int") - 2 * f["section"].cast("int") + 2 * (f["role"] != "unknown").cast("int") + (f["level"] != "unknown").cast("int") + (F.size(f["names"]) > 0).cast("int")
            return F.struct(score.alias("score"), (-c["kind"]).alias("kind"), (-c["i"]).alias("i"), c["text"].alias("text"), f.alias("f"))

        return let(facts, sum_)

    best = F.array_max(F.transform(F.filter(let(lined, candidates), lambda c: c["text"] != ""), scored))

    def result(b: Column) -> Column:
        k, middle, least = (0.35, 3.0, 0.55) if strict else (0.25, 2.0, 0.45)
        sure = F.when(b.isNull(), 0.0).otherwise(logistic(b["score"], k, middle))
        warned = [F.when(b.isNull(), "title_not_found"), F.when(~b["f"]["fits"] | (sure < least), "title_low_confidence"), F.when(b["f"]["section"], "title_looks_like_section")]
        return F.struct(F.when(b["f"]["fits"], b["text"]).alias("value"), F.coalesce(b["f"]["role"], F.lit("unknown")).alias("role"), F.coalesce(b["f"]["level"], F.lit("unknown")).alias("level"), F.coalesce(b["f"]["names"], F.array().cast("array<string>")).alias("specialization"), b["text"].alias("raw"), sure.alias("confidence"), F.array_compact(F.array(*warned)).alias("warnings"))

    return let(best, result)
