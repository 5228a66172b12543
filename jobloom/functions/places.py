"""Location of a posting: city, country, relocation and visa support, from its sections.

Places come from two tables of names, which code reads and never spells out: further rows need no code.  A name stands
between ASCII word boundaries; ``~`` marks one that counts anywhere, ``=`` one between characters that are no Cyrillic
letters, ``*`` the start of a word.  The first row of a table that a text names wins.  In a record's plan, names of one
ASCII word are looked up among a text's words and the others by one pattern, where a text can hold one at all; over
whole tables ``mentions`` joins texts with names by their first word and verifies them.

Of all places of a posting the one with the greatest score counts, of equal ones the first: by section, then "City,
Country" and the like, then cities, then countries.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import confidence, text_of, weight
from .patterns import any_part, has, java, let, lowered, met, plain_part, replace
from .text import WHOLE_TOKENS

# Cities, their countries and names, in the order in which they are looked for.
CITIES = """
Moscow; Russia; moscow, ~москва
Saint Petersburg; Russia; saint petersburg, saintpetersburg, spb, ~санкт-петербург, ~санктпетербург, ~питер
Novosibirsk; Russia; novosibirsk, ~новосибирск
Minsk; ; minsk, ~минск
Tbilisi; Georgia; tbilisi, ~тбилиси
Yerevan; Armenia; yerevan, ~ереван
Batumi; Georgia; batumi, ~батуми
Warsaw; Poland; warsaw, ~варшава
Berlin; Germany; berlin, ~берлин
London; UK; london, ~лондон
Amsterdam; Netherlands; amsterdam
Paris; France; paris
Madrid; Spain; madrid
Barcelona; Spain; barcelona
Rome; Italy; rome, roma
Milan; Italy; milan, milano
Dublin; Ireland; dublin
Lisbon; Portugal; lisbon, lisboa
Porto; Portugal; porto
Vienna; Austria; vienna, wien
Prague; Czechia; prague, praha
Brno; Czechia; brno
Budapest; Hungary; budapest
Bucharest; Romania; bucharest, bucurești
Sofia; Bulgaria; sofia
Helsinki; Finland; helsinki
Tallinn; Estonia; tallinn
Riga; Latvia; riga
Vilnius; Lithuania; vilnius
Zagreb; Croatia; zagreb
Ljubljana; Slovenia; ljubljana
Bratislava; Slovakia; bratislava
Luxembourg; Luxembourg; luxembourg
Reykjavik; Iceland; reykjavik, reykjavík
Belgrade; Serbia; belgrade, ~белград
Novi Sad; Serbia; novi sad
Almaty; Kazakhstan; almaty, ~алматы
Athens; Greece; athens, ~αθήνα
Thessaloniki; Greece; thessaloniki, ~θεσσαλονίκη
Nicosia; Cyprus; nicosia, ~lefkosia, ~λευκωσία
Limassol; Cyprus; limassol, ~λεμεσός
Larnaca; Cyprus; larnaca, ~λάρνακα, ~λάrνακα
Manchester; UK; manchester
Birmingham; UK; birmingham
Liverpool; UK; liverpool
Edinburgh; UK; edinburgh
Glasgow; UK; glasgow
Leeds; UK; leeds
Bristol; UK; bristol
Munich; Germany; munich, münchen
Hamburg; Germany; hamburg
Frankfurt; Germany; frankfurt
Cologne; Germany; cologne, köln
Stuttgart; Germany; stuttgart
Düsseldorf; Germany; düsseldorf
Dortmund; Germany; dortmund
Essen; Germany; essen
Lyon; France; lyon
Marseille; France; marseille
Toulouse; France; toulouse
Nice; France; nice
Nantes; France; nantes
Strasbourg; France; strasbourg
Montpellier; France; montpellier
Naples; Italy; naples, napoli
Turin; Italy; turin, torino
Palermo; Italy; palermo
Genoa; Italy; genoa, genova
Bologna; Italy; bologna
Florence; Italy; florence, firenze
Bari; Italy; bari
Valencia; Spain; valencia
Seville; Spain; seville, sevilla
Zaragoza; Spain; zaragoza
Málaga; Spain; málaga, malaga
Murcia; Spain; murcia
Bilbao; Spain; bilbao
Rotterdam; Netherlands; rotterdam
The Hague; Netherlands; the hague, den haag
Utrecht; Netherlands; utrecht
Eindhoven; Netherlands; eindhoven
Antwerp; Belgium; antwerp, antwerpen
Ghent; Belgium; gent, ghent
Bruges; Belgium; bruges, brugge
Zurich; Switzerland; zurich, zürich
Geneva; Switzerland; geneva, genève
Basel; Switzerland; basel
Bern; Switzerland; bern, berne
Lausanne; Switzerland; lausanne
Graz; Austria; graz
Linz; Austria; linz
Salzburg; Austria; salzburg
Krakow; Poland; krakow, kraków
Wroclaw; Poland; wroclaw, wrocław
Poznan; Poland; poznan, poznań
Gdansk; Poland; gdansk, gdańsk
Ostrava; Czechia; ostrava
Debrecen; Hungary; debrecen
Szeged; Hungary; szeged
Cluj-Napoca; Romania; cluj
Timișoara; Romania; timișoara, timisoara
Iași; Romania; iași, iasi
Plovdiv; Bulgaria; plovdiv
Varna; Bulgaria; varna
Split; Croatia; split
Bergen; Norway; bergen
Trondheim; Norway; trondheim
Gothenburg; Sweden; gothenburg, göteborg
Malmö; Sweden; malmö, malmo
Aarhus; Denmark; aarhus
Tampere; Finland; tampere
Turku; Finland; turku
Cork; Ireland; cork
Tel Aviv; Israel; tel aviv, tel avivyafo
Jerusalem; Israel; jerusalem
Haifa; Israel; haifa
Rishon LeZion; Israel; rishon lezion, rishon le zion, rishon le-zion
Petah Tikva; Israel; petah tikva
Ashdod; Israel; ashdod
Netanya; Israel; netanya
Beer Sheva; Israel; beer sheva, beersheba
Dubai; UAE; dubai
Abu Dhabi; UAE; abu dhabi
Sharjah; UAE; sharjah
Ajman; UAE; ajman
Ras Al Khaimah; UAE; ra's al khaimah, ra's al-khaimah, ra's alkhaimah
Fujairah; UAE; fujairah
Umm Al Quwain; UAE; umm al quwain, umm al-quwain, umm alquwain
Beijing; China; beijing, peking
Shanghai; China; shanghai
Guangzhou; China; guangzhou
Shenzhen; China; shenzhen
Chengdu; China; chengdu
Hangzhou; China; hangzhou
Wuhan; China; wuhan
Xi'an; China; xi'an, xian
Nanjing; China; nanjing
Tianjin; China; tianjin
Tokyo; Japan; tokyo
Yokohama; Japan; yokohama
Osaka; Japan; osaka
Nagoya; Japan; nagoya
Sapporo; Japan; sapporo
Fukuoka; Japan; fukuoka
Kyoto; Japan; kyoto
Kobe; Japan; kobe
Seoul; South Korea; seoul
Busan; South Korea; busan
Incheon; South Korea; incheon
Daegu; South Korea; daegu
Daejeon; South Korea; daejeon
Gwangju; South Korea; gwangju
Mumbai; India; mumbai, bombay
Delhi; India; delhi
Bangalore; India; bangalore, bengaluru
Hyderabad; India; hyderabad
Chennai; India; chennai, madras
Kolkata; India; kolkata, calcutta
Pune; India; pune
Jaipur; India; jaipur
Surat; India; surat
Lucknow; India; lucknow
Singapore; Singapore; singapore
Bangkok; Thailand; bangkok
Chiang Mai; Thailand; chiang mai
Phuket; Thailand; phuket
Ho Chi Minh City; Vietnam; ho chi minh city, saigon
Hanoi; Vietnam; hanoi
Da Nang; Vietnam; da nang
Manila; Philippines; manila
Cebu; Philippines; cebu
Davao; Philippines; davao
Jakarta; Indonesia; jakarta
Surabaya; Indonesia; surabaya
Bandung; Indonesia; bandung
Medan; Indonesia; medan
Kuala Lumpur; Malaysia; kuala lumpur
Penang; Malaysia; penang, george town
Johor Bahru; Malaysia; johor bahru
Taipei; Taiwan; taipei
Kaohsiung; Taiwan; kaohsiung
Taichung; Taiwan; taichung
Hong Kong; Hong Kong; hong kong
Riyadh; Saudi Arabia; riyadh, riyad
Jeddah; Saudi Arabia; jeddah
Dammam; Saudi Arabia; dammam
Mecca; Saudi Arabia; mecca, makkah
Medina; Saudi Arabia; medina, madinah
Doha; Qatar; doha
Kuwait City; Kuwait; kuwait city
Manama; Bahrain; manama
Muscat; Oman; muscat
Istanbul; Turkey; istanbul
Ankara; Turkey; ankara
Izmir; Turkey; izmir
Antalya; Turkey; antalya
Bursa; Turkey; bursa
New York; USA; nyc, new york
San Francisco; USA; sf, san francisco
"""
# Countries and their names, in the order in which they are looked for.
COUNTRIES = """
Russia; russia, rf, ru, =россия, =рф
USA; usa, us, united states
UK; uk, united kingdom, great britain, gb
Ireland; ireland, ie
Portugal; portugal, pt
Belgium; belgium, be
Austria; austria, at
Czechia; czechia, czech republic, cz
Hungary; hungary, hu
Romania; romania, ro
Bulgaria; bulgaria, bg
Finland; finland, fi
Estonia; estonia, ee
Latvia; latvia, lv
Lithuania; lithuania, lt
Croatia; croatia, hr
Slovenia; slovenia, si
Slovakia; slovakia, sk
Luxembourg; luxembourg, lu
Iceland; iceland, is
Greece; greece, hellas, ellada, ελλάδα, hellenic
Cyprus; cyprus, κύπρος, ~кипр
Switzerland; switzerland, schweiz, suisse
Sweden; sweden, sverige
Norway; norway, norge
Denmark; denmark, danmark
France; france
Netherlands; netherlands, holland
Spain; spain, españa
Italy; italy, italia
Germany; germany, deutschland
Poland; pol*
Georgia; georgia
Armenia; armenia
Serbia; serbia
UAE; uae, united arab emirates
Kazakhstan; kazakhstan, казахстан
Ukraine; ukraine, украина
Israel; israel, il
China; china, prc, people's republic of china
Japan; japan, jp
South Korea; south korea, korea, republic of korea, rok
India; india, in
Singapore; singapore, sg
Thailand; thailand, th
Vietnam; vietnam, vn
Philippines; philippines, ph
Indonesia; indonesia, id
Malaysia; malaysia, my
Taiwan; taiwan, tw
Hong Kong; hong kong, hk
Saudi Arabia; saudi arabia, sa
Qatar; qatar
Kuwait; kuwait, kw
Bahrain; bahrain, bh
Oman; oman, om
Turkey; turkey, tr, türkiye
"""
# Countries by the code that a posting's source may give.
CODES = """
DE Germany, AT Austria, CH Switzerland, FR France, ES Spain, IT Italy, PT Portugal, NL Netherlands, BE Belgium, LU Luxembourg, IE Ireland, GB UK, UK UK, SE Sweden, NO Norway, DK Denmark, FI Finland, IS Iceland,
PL Poland, CZ Czechia, SK Slovakia, SI Slovenia, HR Croatia, RO Romania, BG Bulgaria, HU Hungary, LT Lithuania, LV Latvia, EE Estonia, CY Cyprus, GR Greece, UA Ukraine, BY Belarus, KZ Kazakhstan, GE Georgia, AM Armenia,
AZ Azerbaijan, TR Turkey, RU Russia, US USA, CA Canada, AU Australia, NZ New Zealand, SG Singapore, TH Thailand, VN Vietnam, PH Philippines, ID Indonesia, MY Malaysia, CN China, JP Japan, KR South Korea, IN India, IL Israel, AE UAE
"""
# States of the USA by their codes.
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
# What can't be a city or a country.
NO_PLACES = ["django", "fastapi", "node.js", "nodejs", "nestjs", "react", "angular", "vue", "postgresql", "mysql", "kafka", "docker", "kubernetes", "gitlab", "github", "prometheus", "grafana", "sentry", "java", "oop", "http", "https", "www", "t", "me", "com", "net", "org", "io", "ai", "app", "dev"]
NO_PLACE_WORDS = ["year", "years", "working", "hours", "working hours", "experience", "benefits", "requirements", "responsibilities", "compensation", "salary", "offer", "retirement", "pto", "bonus", "ote", "k"]
NO_CITY, NO_COUNTRY = r"\b(office|format|hybrid|remote|onsite)\b", r"(формат|гибрид|удал|office|remote|onsite|hybrid)"
RELOCATION = r"(\brelocation\b|релокац|переезд|\brelocate\b)"
VISA = r"(\bvisa\b|виза|work\s+permit|разрешени[ея]\s+на\s+работу)"
REGIONS = [("US", r"\b(us|usa|united\s+states)\s+only\b"), ("EU", r"(\b(eu|european\s+union|eea|europe)\s+only\b|\beu-wide\b)"), ("EMEA", r"\bemea\b"), ("APAC", r"\bapac\b")]
# Fixed values: "City, Country", "City (Country)", "City - Country", "City, ST" and a city behind its Russian mark.
_NAME = r"([A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё\- ]{1,40})"
WITH_COMMA, WITH_DASH = rf"(?:[гГ]\.?\s*)?{_NAME}\s*,\s*{_NAME}", rf"{_NAME}\s*[-–—]\s*{_NAME}"
IN_BRACKETS = rf"{_NAME}\s*\(\s*([A-Za-zА-Яа-яЁё]{{2,40}})\s*\)"
WITH_STATE, MARKED_CITY = r"([A-Za-z][A-Za-z .'-]{1,40})\s*,\s*([A-Z]{2})\b", r"[гГ]\.?\s*([А-Яа-яЁё][А-Яа-яЁё\- ]{1,40})"
# A name that is stuck to a place.
_CYRILLIC = r"А-Яа-яЁё0-9\s,/-"
STUCK_SENTENCE = rf"(?<![{_CYRILLIC}])([{_CYRILLIC}]+[а-яё])([А-ЯЁ][А-Яа-яЁё0-9]{{2,40}})(?=\s|$|,|:)"
STUCK_LATIN = rf"(?<![{_CYRILLIC}])([{_CYRILLIC}]+)([A-Z][A-Za-z0-9\s&'.-]{{2,40}})(?=\s|$|,|:)"
STUCK_CASE = r"(?m)^(.{3,}[a-zа-яё0-9])([A-ZА-ЯЁ][A-Za-zА-Яа-яЁё0-9]{1,30})(?=\s|$|,|:)"
STUCK_PAIR = r"\A([^,]+,\s*[^,]+)([A-ZА-ЯЁ][A-Za-zА-Яа-яЁё0-9]{2,30})(?=\s|$|,|:)"


def rows(table: str) -> list[tuple[str, ...]]:
    """The lines of a table above, the names of each as its last field."""
    return [tuple(x.strip() for x in line.split(";")) for line in table.strip().split("\n")]


def names(table: str) -> list[tuple[int, str]]:
    """(row, name with its mark) of every name of a table."""
    return [(k, n.strip()) for k, row in enumerate(rows(table)) for n in row[-1].split(",")]


def name_pattern(name: str) -> str:
    """What a name matches, in the dialect of ``patterns``."""
    plain = re.sub(r"([.'-])", r"\\\1", name.strip("~=*")).replace(r"\'", "'").replace(" ", r"\s+")
    if name[0] == "~":
        return plain
    if name[0] == "=":
        return rf"(?:^|[^А-Яа-яЁё]){plain}(?:$|[^А-Яа-яЁё])"
    return rf"\b{plain}" + (r"\w*\b" if name[-1] == "*" else r"\b")


#: A name that doesn't count before other words: "nice to have".
UNLESS = {"nice": r"(?!\s+to\s+have)"}


def first_named(low: Column, table: str) -> Column:
    """The first row of a table, from 0, that a lower-cased text names, or null."""
    of: dict[str, int] = {}
    for k, name in names(table):
        of.setdefault(name, k)
    words = [x for x in of if re.fullmatch("[a-z0-9_]+", x) and x not in UNLESS]
    longer = sorted((x for x in of if x not in words and x[0] not in "~=" and x[-1] != "*" and x not in UNLESS), key=len, reverse=True)
    marked = [x for x in of if x[0] in "~=" or x[-1] == "*" or x in UNLESS]
    starts = sorted({re.findall("[a-z0-9]+", x)[0] for x in longer if x.isascii()})
    accented = [plain_part(name_pattern(x)[2:-2])[0] for x in longer if not x.isascii()]
    row_of = F.create_map(*(F.lit(x) for k in [*words, *longer] for x in (k, of[k])))
    spelled = java(r"\b(?:" + "|".join(name_pattern(x)[2:-2] for x in longer) + r")\b", fold=False)

    def found(own: Column) -> Column:
        may = F.arrays_overlap(own, F.array(*map(F.lit, starts))) | any_part(low, accented)
        several = F.when(may, F.transform(F.regexp_extract_all(low, F.lit(spelled), F.lit(0)), lambda x: F.regexp_replace(x, java(r"\s+", fold=False), " "))).otherwise(F.array().cast("array<string>"))
        known = F.transform(F.concat(F.array_intersect(own, F.array(*map(F.lit, words))), several), lambda x: F.try_element_at(row_of, x))
        sign = lambda x: F.contains(low, F.lit(x.strip("~=*")))
        hit = lambda x: sign(x) if x[0] == "~" else sign(x) & F.rlike(low, F.lit(java(name_pattern(x) + UNLESS.get(x, ""), fold=False)))
        return F.array_min(F.concat(known, F.array(*(F.when(hit(x), of[x]) for x in marked))))

    return let(F.array_distinct(F.split(low, r"\W+")), found)  # ASCII words of a lower-cased text


def _field(table: str, row: Column, k: int) -> Column:
    return F.get(F.array(*(F.lit(r[k] or None).cast("string") for r in rows(table))), row)


def alias_table(spark: SparkSession) -> DataFrame:
    """(kind, row, name, first_word, pattern): all names of both tables.  ``first_word`` is null for names that count anywhere."""
    every_name = [(kind, k, n) for kind, t in (("city", CITIES), ("country", COUNTRIES)) for k, n in names(t)]
    whole = lambda n: n[0] not in "~=" and n[-1] != "*" and n.isascii()
    data = [(kind, k, n, re.findall("[a-z0-9_]+", n)[0] if whole(n) else None, java(name_pattern(n) + UNLESS.get(n, ""))) for kind, k, n in every_name]
    return spark.createDataFrame(data, "kind string, row int, name string, first_word string, pattern string")


def mentions(texts: DataFrame, text_id: str, text: str, aliases: DataFrame, most: int = 100_000) -> DataFrame:
    """(id, kind, row): the first row of each kind of ``aliases`` that each text names.

    Names of whole words meet a text in a join by their first word and are verified in it; of a text only its distinct
    words are shuffled if the names are too many to broadcast (``most``).  Marked names are few; each is looked for in
    each text.
    """
    named = aliases.where("first_word is not null")
    named = F.broadcast(named) if named.count() <= most else named
    own = texts.select(F.col(text_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    words = own.select("*", F.explode(F.array_distinct(F.split(F.lower("text"), r"\W+"))).alias("first_word"))
    by_word = words.join(named, "first_word").where(F.rlike("text", F.col("pattern")))
    anywhere = own.join(F.broadcast(aliases.where("first_word is null")), F.rlike("text", F.col("pattern")))
    return by_word.select("id", "kind", "row").unionByName(anywhere.select("id", "kind", "row")).groupBy("id", "kind").agg(F.min("row").alias("row"))


def cut(text: Column) -> Column:
    """A place without the name that is stuck to it: what stands before the first name that looks so; else the text."""
    cyrillic = lambda x: F.rlike(x, F.lit("[А-Яа-яЁё]"))
    trim = lambda x: replace(x, r"^\s+|\s+$", "")
    token = lambda b: F.lower(b).isin(*(w.lower() for w in WHOLE_TOKENS))
    code = lambda b: F.rlike(b, F.lit("^[A-Z]{1,3}$"))

    def judged(pattern: str, may: Column, fits) -> Column:
        """What the first match leaves if ``fits`` of both its parts."""
        rule = java(pattern, fold=False)
        pair = F.struct(trim(F.regexp_extract(text, rule, 1)).alias("a"), trim(F.regexp_extract(text, rule, 2)).alias("b"))
        return F.when(may & F.rlike(text, F.lit(rule)), let(pair, lambda p: F.when(fits(p["a"], p["b"]), p["a"])))

    size, always = F.length, F.lit(True)
    return F.coalesce(
        judged(STUCK_SENTENCE, cyrillic(text), lambda a, b: (size(a) > 3) & (size(b) >= 2)),
        judged(STUCK_LATIN, cyrillic(text), lambda a, b: (size(a) > 2) & cyrillic(a) & (~code(b) | (size(a) > 10)) & ~token(b)),
        judged(STUCK_CASE, always, lambda a, b: (size(a) > 3) & (size(b) >= 2) & ((size(b) >= 3) | (size(a) > 10)) & ~token(b)),
        judged(STUCK_PAIR, cyrillic(text), lambda a, b: (size(a) > 5) & cyrillic(a) & F.rlike(b, F.lit("^[A-Z]")) & ~token(b)),
        text,
    )


def explicit(text: Column) -> Column:
    """struct<city, country> that a text spells out, or null.  The first thing that looks like a pair decides, also if it is none."""
    pair = lambda city, country: F.struct(city.alias("city"), country.alias("country"))

    def match(t: Column, pattern: str, sign: str) -> Column:
        """The first match, or null; looked for where its sign stands."""
        return F.when(F.rlike(t, F.lit(java(sign, False))), F.nullif(F.regexp_extract(t, java(pattern, False), 0), F.lit("")))

    def parts(m: Column, pattern: str) -> Column:
        return pair(F.trim(F.regexp_extract(m, java(pattern, False), 1)), F.trim(F.regexp_extract(m, java(pattern, False), 2)))

    def fits(p: Column, comma: bool) -> Column:
        city, country = F.lower(p["city"]), F.lower(p["country"])
        known = F.rlike(p["country"], F.lit("^[A-Z]{2,3}$")) | first_named(country, COUNTRIES).isNotNull()
        plain = lambda x: F.rlike(x, F.lit(r"^[a-z][a-z\s-]+$"))
        bad = has(city, NO_CITY) | has(country, NO_COUNTRY) | city.isin(*NO_PLACES, *NO_PLACE_WORDS) | country.isin(*NO_PLACES, *NO_PLACE_WORDS) | (F.length(city) <= 2) | (plain(p["city"]) & plain(p["country"]))
        if comma:
            many = lambda x: F.size(F.filter(F.split(x, " +"), lambda w: w != "")) > 3
            camel = lambda x: F.rlike(x, F.lit("[a-z][A-Z]"))
            bad = bad | many(p["city"]) | many(p["country"]) | camel(p["city"]) | camel(p["country"])
        return ~bad & known

    def taken(m: Column, pattern: str, comma: bool = False) -> Column:
        return let(parts(m, pattern), lambda p: F.when(fits(p, comma), p))

    def or_else(m: Column, pattern: str, rest: Column, comma: bool = False) -> Column:
        return let(m, lambda x: F.when(x.isNotNull(), taken(x, pattern, comma)).otherwise(rest))

    marked = match(text, MARKED_CITY, "[гГ]")
    in_mark = let(marked, lambda m: F.when(m.isNotNull(), pair(F.trim(F.regexp_extract(m, java(MARKED_CITY, False), 1)), F.lit(None).cast("string"))))

    def in_state(m: Column) -> Column:
        us = lambda p: F.when(p["country"].isin(*STATES) & ~has(F.lower(p["city"]), NO_CITY), pair(p["city"], F.lit("USA")))
        return F.coalesce(let(parts(m, WITH_STATE), us), in_mark)

    state = let(match(text, WITH_STATE, r",\s*[A-Z]{2}\b"), lambda m: F.when(m.isNotNull(), in_state(m)).otherwise(in_mark))
    dash = or_else(match(text, WITH_DASH, r"[-–—]\s*[A-Za-zА-Яа-яЁё]"), WITH_DASH, state)
    bracket = or_else(match(text, IN_BRACKETS, r"\(\s*[A-Za-zА-Яа-яЁё]{2,40}\s*\)"), IN_BRACKETS, dash)
    return or_else(let(cut(text), lambda t: match(t, WITH_COMMA, r",\s*[A-Za-zА-Яа-яЁё]")), WITH_COMMA, bracket, True)


_PLACE = "struct<score:int,order:int,city:string,country:string>"


def location(sections: Column, country: Column | None = None) -> Column:
    """struct<city, country, relocation, visa_support, regions, confidence>; ``country`` is a code, taken where a text names none."""

    def of(s: Column, i: Column) -> Column:
        bare = lambda t: F.when(F.contains(t, F.lit("://")), replace(t, r"https?://\S+", " ")).otherwise(t)
        plain = let(let(text_of(s), bare), lambda t: F.when(F.contains(t, F.lit("@")), replace(t, r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", " ")).otherwise(t))
        hit = lambda more, k, city, where: F.struct((weight(s) + more).cast("int").alias("score"), (-(i * 3 + k)).cast("int").alias("order"), city.alias("city"), where.alias("country"))

        def spelled(p: Column) -> Column:
            def known(c: Column) -> Column:
                row, land = first_named(F.lower(c), CITIES), first_named(F.lower(p["country"]), COUNTRIES)
                return let(F.struct(row.alias("row"), land.alias("land")), lambda r: hit(3, 0, F.coalesce(_field(CITIES, r["row"], 0), c), F.coalesce(_field(COUNTRIES, r["land"], 0), p["country"], _field(CITIES, r["row"], 1))))

            return F.when(p.isNotNull(), let(cut(p["city"]), known))

        def places(f: Column) -> Column:
            city = F.when(f["row"].isNotNull(), hit(2, 1, _field(CITIES, f["row"], 0), _field(CITIES, f["row"], 1)))
            land = F.when(f["land"].isNotNull(), hit(1, 2, F.lit(None).cast("string"), _field(COUNTRIES, f["land"], 0)))
            return F.array_compact(F.array(let(f["pair"], spelled).cast(_PLACE), city.cast(_PLACE), land.cast(_PLACE)))

        named = lambda t, table: let(F.lower(t), lambda low: first_named(low, table))
        looked = lambda t: let(cut(t), lambda c: F.struct(explicit(c).alias("pair"), named(c, CITIES).alias("row"), named(t, COUNTRIES).alias("land")))
        return let(let(plain, looked), places)

    facts = lambda lows: F.struct(F.array_max(F.flatten(F.transform(sections, of))).alias("best"), seen(lows, RELOCATION).alias("relocation"), seen(lows, VISA).alias("visa"), seen(lows, "кипр").alias("cyprus"), F.array_compact(F.array(*(F.when(seen(lows, p), name) for name, p in REGIONS))).alias("regions"))
    codes = F.create_map(*(F.lit(x) for pair in CODES.replace("\n", " ").split(",") for x in pair.strip().split(" ", 1)))
    home = F.try_element_at(codes, F.upper(F.trim(country))) if country is not None else F.lit(None).cast("string")

    seen = lambda lows, p: F.exists(lows, lambda t: F.coalesce(met(t, p), F.lit(False)))

    def result(f: Column) -> Column:
        where = F.coalesce(f["best"]["country"], F.when(f["cyprus"], "Cyprus"), home)
        found = f["best"]["city"].isNotNull() | where.isNotNull() | f["relocation"] | f["visa"]
        regions = F.when(f["best"]["city"].isNull() & where.isNull(), f["regions"]).otherwise(F.array().cast("array<string>"))
        return F.struct(f["best"]["city"].alias("city"), where.alias("country"), f["relocation"].alias("relocation"), f["visa"].alias("visa_support"), regions.alias("regions"), confidence(found, 0.3 + 0.1 * F.least(F.lit(8), F.coalesce(f["best"]["score"], F.lit(1)))).alias("confidence"))

    return let(let(F.transform(sections, lambda s: lowered(text_of(s))), facts), result)
