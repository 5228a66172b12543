"""Text functions, gate and extractors on literal rows, quirks included."""

import pytest
from pyspark.sql import functions as F

from jobloom.functions import extract, gate, places, text, titles, urls
from jobloom.functions.salary import salary
from jobloom.plans import parse


@pytest.fixture(scope="module")
def value(spark):
    def of(make, x, schema="x string"):
        return spark.createDataFrame([(x,)], schema).select(make(F.col("x")).alias("y")).first().y

    return of


@pytest.mark.parametrize(
    "raw, want",
    [
        ("<p>A&amp;B</p><div>c<br/>d</div>", "A&B\n\nc\nd"),
        ("<ul><li>x</li></ul>", "- x\n-"),
        ("a<script>var x = '<p>';</script>b", "ab"),
        ("a  – b\t\tc\r\n\r\n\r\n\r\nd", "a  - b c\n\nd"),
        (None, ""),
    ],
)
def test_preprocess(value, raw, want):
    assert value(text.preprocessed, raw) == want


@pytest.mark.parametrize("raw, want", [("", "unknown"), ("123", "unknown"), ("привет", "ru"), ("hello", "en"), ("привет hello", "mixed"), (None, "unknown")])
def test_script(value, raw, want):
    assert value(text.detect_lang, raw) == want


def test_sections(value):
    got = value(lambda x: text.sections(text.lines(x)), "Dev\nRequirements: Python\nSQL\nNice to have:\nGo\nТребования\nЧто-то")
    assert [(s.name, s.lines) for s in got][1:] == [("body", ["Dev"]), ("requirements", ["Python", "SQL"]), ("nice_to_have", ["Go", "Требования", "Что-то"])]
    assert got[0].name == "head" and len(got[0].lines) == 7


def test_cyrillic_headers_need_an_ascii_boundary(value):
    assert value(text.header_of, "Требования") is None
    assert value(text.header_of, "ТребованияX") == "requirements"
    assert value(text.header_of, "Benefits and more") == "benefits"
    assert value(text.header_of, "Benefitsx") is None


@pytest.mark.parametrize(
    "raw, want",
    [("https://www.Example.com/a/", "example.com/a"), ("https://t.me/s/jobs", "t.me/jobs"), ("http://x.com/feed/?id=1", "x.com/feed?id=1"), ("http://x.com/a?b=1", "x.com/a?b=1"), (None, "")],
)
def test_url_normal_form(value, raw, want):
    assert value(urls.normalize, raw) == want


def test_urls(value):
    assert value(urls.host, "https://User@Jobs.Example.co.uk:8080/x") == "jobs.example.co.uk"
    assert value(urls.hints, "https://x.co.uk/").asDict() == {"country": "GB", "currency": "GBP"}
    assert (value(urls.telegram_slug, "https://t.me/s/abc_1/42"), value(urls.telegram_message, "https://t.me/abc_1/42")) == ("abc_1", 42)
    assert value(lambda x: urls.source_type(F.lit(""), x), "https://m.facebook.com/x") == "facebook"
    assert value(lambda x: urls.source_type(F.lit("rss"), x), "https://t.me/x") == "rss"
    assert value(urls.valid_link, "javascript:x") is None


@pytest.mark.parametrize(
    "title, body, want",
    [
        ("x", " ", "empty_description"),
        ("Вакансия", "коротко", "too_short_generic"),
        ("x", "Dieses Stellenangebot gibt es nicht mehr", "job_unavailable_page"),
        ("Resume of Ann", "developer", "resume_post"),
        ("x", "my name is Ann", "resume_post"),
        ("x", "just words", "no_vacancy_signals"),
        ("Developer", "We are looking for a developer. Apply: a@b.com", "ok"),
    ],
)
def test_gate(spark, title, body, want):
    df = spark.createDataFrame([(title, body)], "t string, d string")
    assert df.select(gate.vacancy_reason(F.col("t"), F.col("d"))).first()[0] == want


def test_anomalies(spark):
    make = lambda t, loc="": spark.createDataFrame([(t, loc)], "t string, l string").select(gate.anomaly_reasons(F.col("t"), F.col("l"), F.col("t"))).first()[0]
    long = " word" * 60
    assert make("120 000 EUR" + long) == ["low_salary"]  # the digits right before the currency
    assert make("900 EUR" + long, "Java, remote") == ["fake_location"]
    assert make("hi all") == ["resume", "too_short"]
    assert make("") == []


GOLDEN = """Senior Backend Developer
Company: Example 2 Inc
Full-time, remote. 3-5 years experience.
Requirements:
Python, PostgreSQL, React Native, C++
English B2
Nice to have: German, Docker
Benefits: insurance, gym, 40 hours per week, 5/2
1) HR call 2) Technical round 3) Final
Contacts: Jobs@Example.com, @recruiter_1, https://example.com/careers."""


@pytest.fixture(scope="module")
def record(spark):
    return parse.parsed(spark.createDataFrame([(GOLDEN,)], "text string"), "text").first()


def test_record(record):
    assert record.contacts.emails == ["jobs@example.com"] and record.contacts.telegram == ["@recruiter_1"] and record.contacts.urls == ["https://example.com/careers"]
    assert record.employment.types == ["full_time"] and record.work_format.value == "remote"
    assert (record.experience.min_years, record.experience.max_years) == (3, 5)
    assert record.tech.must == ["C", "C++", "PostgreSQL", "Python", "React", "React Native"] and record.tech.plus == ["Docker"]
    assert [(x.language, x.level) for x in record.languages.required] == [("English", "B2")]
    assert record.benefits.values == ["gym", "insurance", "remote"]
    assert record.schedule.hours_per_week == 40 and record.schedule.patterns == ["5/2"]
    assert record.interview.steps == ["Final", "HR", "Tech"] and record.company.name == "Example 2 Inc"
    assert record.total == max(getattr(record, n).confidence for n in parse.FIELDS) and record.warnings == ["salary_not_found"] and record.location.country == "Croatia" and record.title.value == "Senior Backend Developer"


def test_empty_record(spark):
    got = parse.parsed(spark.createDataFrame([(None,)], "text string"), "text").first()
    assert got.warnings[0] == "empty_text" and got.total == 0 and got.sections == []


def test_technology_boundaries(value):
    body = lambda x: extract.tech(F.array(F.struct(F.lit("body").alias("name"), F.array(x).alias("lines"))))["all"]
    assert value(body, "javascript Cоздание") == ["JavaScript"]
    assert value(body, "Node.js, asp.net core") == ["ASP.NET", "JavaScript", "Node.js"]


def test_counts_and_dates(value):
    assert [value(text.parse_count, x) for x in ("12.5K subscribers", "1 200", "3 млн")] == [12500, 1200, 3_000_000]
    assert [str(value(text.parse_date, x)) for x in ("1700000000", "1700000000000", "2024-01-02 03:04", "x")] == ["2023-11-14 22:13:20", "2023-11-14 22:13:20", "2024-01-02 03:04:00", "None"]
    assert value(text.compact_money, 1200, "x bigint") == "1.2K"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Salary: $3000-$5000 per month net", (3000, 5000, "USD", "month", "net")),
        ("от 120 000 до 200 000 руб", (120000, 200000, "RUB", "month", "unknown")),
        ("Base 90k - 120k EUR per annum", (90000, 120000, "EUR", "year", "unknown")),
        ("65.000 EUR per annum", (65000, 65000, "EUR", "year", "unknown")),
        ("200-250 тыс ₽", (200, 250, "RUB", "month", "unknown")),  # the multiplier needs an ASCII boundary
        ("5 years experience, 2020-2024", (None, None, "UNKNOWN", "unknown", "unknown")),
        ("Salary in EUR", (None, None, "EUR", "unknown", "unknown")),
        ("founded in 2013", (None, None, "UNKNOWN", "unknown", "unknown")),
    ],
)
def test_salary(value, raw, want):
    got = value(lambda x: salary(text.sections(text.lines(x)), strict=True), raw)
    assert tuple(got)[:5] == want


def _sections(body):
    return F.array(F.struct(F.lit("head").alias("name"), F.split(body, "\n").alias("lines")))


PLACES = [
    ("Локация: Москва, РФ", "Moscow", "Russia"),
    ("Location: Berlin, Germany", "Berlin", "Germany"),
    ("Office in Тбилиси, гибридный формат", "Tbilisi", "Georgia"),
    ("Dublin (IE)", "Dublin", "Ireland"),
    ("Springfield, OH", "Springfield", "OH"),  # two capitals behind a comma are taken for a country before they are for a state
    ("We are in New York and Tel Aviv", "Tel Aviv", "Israel"),  # of equal scores the first in the tables
    ("US only", None, "USA"),
    ("St. Louis, MO", "Louis", "MO"),
    ("1) HR call", None, "Croatia"),  # codes count wherever they stand alone
    ("Nice to have: Go", None, None),
    ("Berlin - Germany", "Berlin", "Germany"),
    ("Помогают с релокацией на Кипр", "ают с релокацией на Кипр", "Cyprus"),  # the mark of a city is found inside of words, too
    ("г. Казань", "Казань", None),
    ("БатумиМеждународная компания", "Batumi", "Georgia"),
    ("Stack: Django, FastAPI\nOffice: Berlin, Germany", "Berlin", "Germany"),  # the first pair is none; the city's name counts
    ("Stack: Django, FastAPI", None, None),
    ("Apply: https://forms.example.ru/cloud/123", None, None),
    ("Мы делаем удобные интерфейсы для iPhone/iPad", None, None),
    ("", None, None),
]


def test_location(spark):
    df = spark.createDataFrame([(k, x) for k, (x, *_) in enumerate(PLACES)], "k int, x string").select("k", places.location(_sections(F.col("x"))).alias("l"))
    got = {r.k: r.l for r in df.collect()}
    for k, (raw, city, country) in enumerate(PLACES):
        assert (got[k].city, got[k].country) == (city, country) and (got[k].confidence > 0) == bool(city or country), raw


def test_location_flags_and_regions(value):
    got = value(lambda x: places.location(_sections(x)), "Relocation package available. Visa support provided.")
    assert got.relocation and got.visa_support and got.confidence == 0.4
    got = value(lambda x: places.location(_sections(x)), "EMEA and APAC teams, EU only")
    assert got.regions == ["EU", "EMEA", "APAC"] and got.country is None


@pytest.mark.parametrize(
    "raw, title, role, level",
    [
        ("Senior Backend Developer (Node.js, NestJS)\nRequirements: SQL", "Senior Backend Developer (Node.js, NestJS)", "backend_developer", "senior"),
        ("Hello\nPosition: Data Engineer", "Data Engineer", "data_engineer", "unknown"),
        ("Вакансия: Тестировщик", "Тестировщик", "qa_engineer", "unknown"),
        ("Удаленка, парт-тайм", None, "unknown", "unknown"),
        ("Source: HH\nhttps://x.example/1", None, "unknown", "unknown"),
        ("PRODUCT MANAGER\nlead of nothing", "PRODUCT MANAGER", "product_manager", "unknown"),
        ("", None, "unknown", "unknown"),
    ],
)
def test_title(value, raw, title, role, level):
    got = value(lambda x: titles.title(text.lines(x)), raw)
    assert (got.value, got.role, got.level) == (title, role, level)
    assert ("title_not_found" in got.warnings) == (raw == "")


def test_title_confidence_is_logistic(value):
    import math

    got = value(lambda x: titles.title(text.lines(x)), "Senior Backend Developer (Node.js)")
    assert math.isclose(got.confidence, 1 / (1 + math.exp(-0.25 * (2 + 1 + 2 + 1 + 1 - 2)))) and "Node.js" in got.specialization


@pytest.mark.parametrize(
    "raw, country, want",
    [("Телефон: +7 (999) 123-45-67", None, ["+79991234567"]), ("8 999 123-45-67", "RU", ["+79991234567"]), ("650-253-0000", "US", ["+16502530000"]), ("650-253-0000", None, []), ("+1 650 253", None, []), ("order 12345678901234", None, [])],
)
def test_phones(value, raw, country, want):
    got = value(lambda x: extract.contacts(x, F.lit(country)), raw)
    assert got.phones == want and (got.confidence > 0) == bool(want)


@pytest.mark.parametrize(
    "raw, name",
    [
        ("Вакансия: IT Support Manager Компания: Kwaaka Локация: Удалённо", "Kwaaka"),
        ("Product Manager (Web) в AIBY: Можно работать удалённо", "AIBY"),
        ("We are a fast growing team. Join us!", None),
        ("Stack: TypeScript, NestJS", None),
        ("Finance / Data AnalystSTARTRIBE LTD\nМосква", "STARTRIBE"),
        ("Senior Backend Developer TypeScript", None),
        ("Специалист по сверке данныхITea", "ITea"),
        ("Die medatixx GmbH & Co. KG ist gemeinsam mit ihrem Tochterunternehmen I-Motion GmbH ein Anbieter von Software.", "medatixx GmbH & Co. KG"),
    ],
)
def test_company_forms(value, raw, name):
    assert value(extract.company, raw).name == name


def test_shown_values(spark):
    rows = [(1200.0, 3000.0, "EUR", "month"), (20.0, None, "USD", "hour"), (None, None, "USD", "hour"), (50000.0, 50000.0, "UNKNOWN", "year")]
    df = spark.createDataFrame(rows, "low double, high double, currency string, period string")
    assert [r.x for r in df.select(text.shown_salary(*map(F.col, df.columns)).alias("x")).collect()] == ["1.2K–3K EUR", "20 USD /час", "—", "50K /год"]
    words = spark.createDataFrame([([" ts ", "Nodejs", "Rust", "node"],)], "x array<string>")
    assert words.select(extract.canonical(F.col("x")).alias("y")).first().y == ["Node.js", "Rust", "TypeScript"]


@pytest.mark.parametrize("raw, want", [("Привет", "ru"), ("Straße", "de"), ("garçon", "fr"), ("niño", "es"), ("są", "pl"), ("plain", "en"), (None, "en")])
def test_source_language(value, raw, want):
    assert value(text.source_language, raw) == want


SANITIZED = [
    # text, what it becomes, warnings
    ("a​b⁠c", "a\nb\nc", ["input_separator_normalized"]),
    ("Cоздание роликовС 2013", "Создание роликов С 2013", []),
    ("RUBБез опыта", "RUB Без опыта", []),
    ("дизайнерProduct", "дизайнер Product", []),
    ("веб-дизайнер90 000 RUB", "веб-дизайнер 90 000 RUB", []),
    ("HR-менеджер60 000 – 120 000 RURОбязанности:", "HR-менеджер 60 000 – 120 000 RUR \nОбязанности:", []),
    ("manager1,500 x", "manager 1,500 x", []),
    ("B2B and C4D", "B2B and C4D", []),
    ("AI-креаторв Cacao", "AI-креатор в Cacao", []),
    ("дизайнерот 1 500", "дизайнер от 1 500", []),
    ("работа данныхITea", "работа данных ITea", []),  # one letter before a name is too little
    ("TypeScript, JavaScript and DevOps", "TypeScript, JavaScript and DevOps", []),
    ("AnalystSTARTRIBE", "AnalystSTARTR IBE", []),  # as much as can be stands before the name
    ("dataAcme, xAcme", "data Acme, xAcme", []),
    ("FooBarBaz", "Foo Bar Baz", []),
    ("myAcmeLLC", "myAcme LLC", []),  # the last name is taken
    ("SeniorDeveloper here", "SeniorDeveloper here", []),  # the name is a word that none is called
    ("конец.Начало (да)Нет", "конец.\nНачало (да)\nНет", []),
    ("Две вакансии:— UI", "Две вакансии:\n— UI", ["multi_vacancy_post"]),
    ("vacancies here\n- one\n- two", "vacancies here\n- one\n- two", ["multi_vacancy_post"]),
    ("пиши @anna_recruiter05— Front", "пиши @anna_recruiter05\n— Front", []),
    ("рынке Что нам важно: x", "рынке \nЧто нам важно: x", []),
    ("We work. Requirements: x", "We work. \nRequirements: x", []),
    ("я " * 120 + "Понравились вакансии? ещё", ("я " * 120).strip(), ["input_truncated"]),
    ("я Понравились вакансии? " + "я " * 120 + "разместить вакансию", "я Понравились вакансии? " + "я " * 120 + "разместить вакансию", []),
    (None, "", []),
]


def test_sanitized(spark):
    from jobloom.functions import text

    df = spark.createDataFrame([(k, x) for k, (x, *_) in enumerate(SANITIZED)], "k int, x string").select("k", text.sanitized(F.col("x")).alias("s"))
    got = {r.k: (r.s.text, r.s.warnings) for r in df.collect()}
    assert [got[k] for k in range(len(SANITIZED))] == [(want, warned) for _, want, warned in SANITIZED]


def test_glue_blocklist(spark):
    from jobloom.functions import text

    rows = [("Type Script", True), ("dev-ops", True), ("", True), (" . ", True), ("я", True), ("x", True), ("xy", False), ("Acme", False), ("K8S", True), ("яя", True)]
    df = spark.createDataFrame(rows, "x string, want boolean").select("x", "want", text.glue_blocked(F.col("x")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_steps_by_their_signs(spark):
    """Steps that are looked for by their signs still act; before, a location put its sections' texts together for each of its rules."""
    df = spark.createDataFrame([("mail x&amp;y",), ("a\u2060b",), ("Some text Requirements: x",)], "t string")
    got = [r.x for r in df.select(text.preprocessed(text.sanitized(F.col("t"))["text"]).alias("x")).collect()]
    assert got == ["mail x&y", "a\nb", "Some text \nRequirements: x"]
    body = F.array(F.struct(F.lit("body").alias("name"), F.array("t").alias("lines")))
    plan = df.select(places.location(body).alias("l"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_join(") <= 3
