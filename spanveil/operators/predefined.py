"""The predefined recognizers.

Patterns, checks, scores and word lists are this library's own definitions;
all can be replaced by building other recognizers.
"""

from __future__ import annotations

from spanveil.functions import checks
from spanveil.functions.spans import WORD, WORD_END, WORD_START, after_boundary
from spanveil.operators.recognizers import Pattern, Recognizer, alternatives, terms_regex

DIGIT = after_boundary("[0-9]")
UPPER = after_boundary("[A-Z]")

# Word lists for dictionary matching.
TLDS = (
    "com org net edu gov mil int info biz name pro jobs mobi travel museum app blog cloud dev io live link online shop site store tech tel "
    "top website wiki xyz ac ae ai ar at au az ba bd be bg bo br by bz ca cc ch ci cl cm cn co cr cy cz de dk do dz ec ee eg es et eu fi "
    "fm fr ge gg gh gr gt hk hn hr hu id ie il im in ir is it je jo jp ke kg kh kr kw kz lb li lk lt lu lv ly ma md me mk mm mn mt mu mx "
    "my na ng ni nl no np nu nz om pa pe ph pk pl pr pt py qa ro rs ru sa se sg si sk sn su sv th tn to tr tt tv tw tz ua ug uk us uy uz "
    "ve vn ws za zm zw"
).split()
MONTHS = "January February March April May June July August September October November December Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec".split()
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Madam".split()
PARTICLES = "da das de del della den der di do dos du el la las le los ten ter van vom von y zu zum zur".split()
GIVEN_NAMES = (
    "Adam Alice Anna Anthony Barbara Benjamin Carlos Charles Christopher Daniel David Elena Elizabeth Emily Emma "
    "Eric Francesca George Giulia Hannah Henry Isabel James Jane Jennifer Jessica John Jonathan Joseph Julia Karen "
    "Kate Katherine Kevin Laura Linda Lisa Lucas Luca Marco Margaret Maria Mark Martin Mary Matthew Michael Michelle "
    "Nancy Nicholas Olivia Patricia Patrick Paul Peter Rachel Rebecca Richard Robert Ryan Samuel Sandra Sarah Simon "
    "André Ana François Gonzalo Inês Jesús João Jorge José Juan Jürgen Luis Luís Manuel Miguel Pablo Pedro René Sofía Zoë "
    "Sofia Sophia Stephen Steven Susan Thomas Timothy Victoria William Winston"
).split()
PLACES = (
    "Africa,Alabama,Alaska,America,Amsterdam,Argentina,Arizona,Asia,Athens,Australia,Austria,Barcelona,Beijing,"
    "Belgium,Berlin,Boston,Brazil,Brussels,Cairo,California,Canada,Chicago,China,Colorado,Copenhagen,Corsica,Dallas,"
    "Delhi,Denmark,Dublin,Egypt,England,Europe,Finland,Florida,France,Geneva,Germany,Greece,Hawaii,Hong Kong,Houston,"
    "India,Indonesia,Ireland,Israel,Italy,Japan,Kenya,Lisbon,London,Los Angeles,Madrid,Maine,Mexico,Miami,Milan,"
    "Moscow,Munich,Naples,Netherlands,New York,New Zealand,Nigeria,Norway,Oslo,Paris,Pisa,Poland,Portugal,Prague,"
    "Rome,Russia,San Francisco,Scotland,Seattle,Singapore,South Africa,Spain,Stockholm,Sweden,Switzerland,Sydney,"
    "Texas,Tokyo,Toronto,Turkey,Ukraine,United Kingdom,United States,Vienna,Virginia,Wales,Warsaw,Washington,Zurich"
).split(",")
GROUPS = (
    "American Argentine Australian Austrian Belgian Brazilian British Canadian Chinese Danish Dutch Egyptian English "
    "Finnish French German Greek Indian Indonesian Irish Israeli Italian Japanese Kenyan Korean Mexican Nigerian "
    "Norwegian Polish Portuguese Russian Scottish Spanish Swedish Swiss Turkish Ukrainian Welsh Anglican Atheist "
    "Buddhist Catholic Christian Hindu Jewish Muslim Orthodox Protestant Sikh Communist Conservative Democrat Liberal "
    "Republican Socialist"
).split()


def _names(words: list[str]) -> str:
    """Capitalised whole terms; the case test keeps most positions cheap."""
    return "(?=[A-Z])" + terms_regex(words)


def _one(name: str, regex: str, score: float, *guards: str) -> tuple[Pattern, ...]:
    return (Pattern(name, regex, score, guards),)


_MONTH = f"(?:{alternatives(MONTHS)})"
_LOCAL = r"[0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
# Names and addresses are taken from their first character on and never given back: linear in the text, whatever
# its length, and no part of a value is left.
_CAPITAL = r"(?:\p{L}{1,2}['’])?\p{Lu}(?:[\p{L}\p{M}]|['’‐-](?=\p{L}))++"
_LINK = rf"(?:(?:{alternatives(PARTICLES)})\h++)"
_SURNAME = rf"(?:\h++{_LINK}*+{_CAPITAL})*+"
_TITLE = rf"(?:{alternatives(TITLES)})\.?"
# what may stand in an address before the @: letters and digits of any script, and the marks that mail allows
_ATOM = r"[\p{L}\p{M}\p{N}_%+.!#$&'*/=?^`{|}~-]"
_CORE = r"[\p{L}\p{N}_%+.-]"
_HOST = r"[\p{L}\p{M}\p{N}_-]++(?:\.[\p{L}\p{M}\p{N}_-]++)++"

PREDEFINED: tuple[Recognizer, ...] = (
    Recognizer(
        "card number", "CREDIT_CARD",
        _one("13 to 19 digits", rf"{DIGIT}(?:[ -]?[0-9]){{12,18}}{WORD_END}", 1.0, "[0-9]"),
        check=checks.card,
    ),
    Recognizer(
        "wallet address", "CRYPTO",
        _one("base 58", rf"{after_boundary('[13]')}[1-9A-HJ-NP-Za-km-z]{{25,34}}{WORD_END}", 1.0, "[0-9]"),
        check=checks.wallet,
    ),
    Recognizer(
        "ISO date", "DATE_TIME",
        _one(
            "year first",
            rf"{DIGIT}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{2}}(?:[T ][0-9]{{2}}:[0-9]{{2}}(?::[0-9]{{2}})?)?{WORD_END}", 0.6,
            "[0-9]", "-",
        ),
        check=checks.iso_date,
    ),
    Recognizer(
        "numeric date", "DATE_TIME",
        _one("day and month", rf"{DIGIT}[0-9]?([/.-])[0-9]{{1,2}}\1[0-9]{{4}}{WORD_END}", 0.6, "[0-9]"),
        check=checks.slashed_date,
    ),
    Recognizer(
        "written date", "DATE_TIME",
        (
            Pattern(
                "month first",
                rf"(?=[ADFJMNOS]){WORD_START}{_MONTH}\.? [0-9]{{1,2}}(?:st|nd|rd|th)?(?:,? [0-9]{{4}})?{WORD_END}", 0.6,
                ("[0-9]",),
            ),
            Pattern(
                "day first",
                rf"{DIGIT}[0-9]?(?:st|nd|rd|th)? (?:of )?{_MONTH}\.?(?:,? [0-9]{{4}})?{WORD_END}", 0.6,
                ("[0-9]",),
            ),
            Pattern("month and year", rf"(?=[ADFJMNOS]){WORD_START}{_MONTH},? [0-9]{{4}}{WORD_END}", 0.6, ("[0-9]",)),
        ),
    ),
    Recognizer(
        "domain", "DOMAIN_NAME",
        # not inside or next to an e-mail address; labels of any number and length, then a look back at the last
        _one(
            "dotted labels",
            rf"[\p{{L}}\p{{N}}_](?<![\p{{L}}\p{{M}}\p{{N}}_@.%+-].)[\p{{L}}\p{{M}}\p{{N}}_-]*+(?:\.[\p{{L}}\p{{M}}\p{{N}}_-]++)++"
            rf"(?<=\.(?i:{alternatives(TLDS)}))(?!@)", 0.5,
            ".", rf"[.](?i:{alternatives(TLDS)})(?![\p{{L}}\p{{N}}_@-])",
        ),
    ),
    Recognizer(
        "e-mail", "EMAIL_ADDRESS",
        _one(
            "address",
            # marks in front of the first letter may be quotes around the address and are not part of it
            rf"{_CORE}(?<=(?<!{_ATOM})[!#$&'*/=?^`{{|}}~]{{0,8}}{_CORE}){_ATOM}*+@{_HOST}(?:@{_HOST})*+", 1.0, "@",
        ),
    ),
    Recognizer(
        "IBAN", "IBAN_CODE",
        (
            Pattern("compact", rf"{UPPER}[A-Z][0-9]{{2}}[A-Z0-9]{{11,30}}{WORD_END}", 1.0, ("[0-9]",)),
            Pattern(
                "in fours",
                rf"{UPPER}[A-Z][0-9]{{2}}(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?{WORD_END}", 1.0,
                ("[0-9]",),
            ),
        ),
        check=checks.iban,
    ),
    Recognizer(
        "IPv4", "IP_ADDRESS",
        _one("four octets", rf"{DIGIT}[0-9]{{0,2}}(?:\.[0-9]{{1,3}}){{3}}{WORD_END}", 0.6, "[0-9]", "."),
        check=checks.ipv4,
    ),
    Recognizer(
        "IPv6", "IP_ADDRESS",
        _one("groups", rf"[0-9A-Fa-f:](?<![\p{{L}}\p{{N}}_:].)[0-9A-Fa-f]{{0,4}}(?::[0-9A-Fa-f]{{0,4}}){{2,7}}(?![\p{{L}}\p{{N}}_:])", 0.6, ":"),
        check=checks.ipv6,
    ),
    Recognizer("places", "LOCATION", _one("dictionary", _names(PLACES), 0.85)),
    Recognizer(
        "medical licence", "MEDICAL_LICENSE",
        _one("two letters, seven digits", rf"{after_boundary('[A-Za-z]')}[A-Za-z9][0-9]{{7}}{WORD_END}", 1.0, "[0-9]{7}"),
        check=checks.medical_licence,
    ),
    Recognizer("groups", "NRP", _one("dictionary", _names(GROUPS), 0.85)),
    Recognizer(
        "names", "PERSON",
        (
            Pattern("given name", rf"(?=[A-Z]){WORD_START}(?:{alternatives(GIVEN_NAMES)}){_SURNAME}{WORD_END}", 0.85),
            Pattern(
                "after a title",
                rf"(?=\p{{L}})(?<={WORD_START}{_TITLE}\h{{1,8}}){_LINK}*+{_CAPITAL}{_SURNAME}", 0.85,
                (rf"[{''.join(sorted({t[0] for t in TITLES}))}](?<!{WORD}.){alternatives({t[1:] for t in TITLES})}\.?\h",),
            ),
        ),
    ),
    Recognizer(
        "phone", "PHONE_NUMBER",
        (
            # two patterns: an optional part in front would be tried at every position
            Pattern("national", rf"\((?<!{WORD_START}1[ .-]\(){_LOCAL}{WORD_END}", 0.4, ("[0-9]", "(")),
            Pattern(
                "national", rf"[+1](?<!{WORD}[+1])(?:(?<=[+])1|(?<=1))[ .-]\({_LOCAL}{WORD_END}", 0.4, ("[0-9]", "(")
            ),
            Pattern("dashed", rf"{DIGIT}[0-9]{{2}}([.-])[0-9]{{3}}\1[0-9]{{4}}{WORD_END}", 0.4, ("[0-9]",)),
            Pattern("international", rf"\+[0-9]{{1,3}}(?:[ .-]?[0-9]{{2,4}}){{2,5}}{WORD_END}", 0.4, ("[0-9]", "+")),
        ),
        context=("phone", "telephone", "call"),
    ),
    Recognizer(
        "NRIC", "SG_NRIC_FIN",
        _one("letter, seven digits, letter", rf"{after_boundary('[STFGM]')}[0-9]{{7}}[A-Z]{WORD_END}", 1.0, "[0-9]{7}"),
        check=checks.nric,
    ),
    Recognizer(
        "NHS number", "UK_NHS",
        _one("ten digits", rf"{DIGIT}[0-9]{{2}}[- ]?[0-9]{{3}}[- ]?[0-9]{{4}}{WORD_END}", 1.0, "[0-9]"),
        check=checks.nhs,
    ),
    Recognizer(
        "bank account", "US_BANK_NUMBER",
        _one("8 to 17 digits", rf"{DIGIT}[0-9]{{7,16}}{WORD_END}", 0.05, "[0-9]{7}"),
        context=("bank", "account"),
    ),
    Recognizer(
        "driver license", "US_DRIVER_LICENSE",
        (
            Pattern("seven digits, letter", rf"{DIGIT}[0-9]{{6}}[A-Z]{WORD_END}", 0.3, ("[0-9]{7}",)),
            Pattern("letter, seven digits", rf"{UPPER}[0-9]{{7}}{WORD_END}", 0.3, ("[0-9]{7}",)),
        ),
        context=("driver", "license"),
    ),
    Recognizer(
        "ITIN", "US_ITIN",
        _one("dashed", rf"9(?<!{WORD}9)[0-9]{{2}}-[5-9][0-9]-[0-9]{{4}}{WORD_END}", 0.5, "[0-9]", "-"),
        context=("itin", "tax"),
    ),
    Recognizer(
        "passport", "US_PASSPORT",
        _one("nine digits", rf"{DIGIT}[0-9]{{8}}{WORD_END}", 0.05, "[0-9]{7}"),
        context=("passport",),
    ),
    Recognizer(
        "social security", "US_SSN",
        _one("dashed", rf"{DIGIT}[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}{WORD_END}", 0.5, "[0-9]", "-"),
        context=("social", "security", "ssn"),
        check=checks.ssn,
    ),
)

SUPPORTED_ENTITIES = tuple(sorted({r.entity_type for r in PREDEFINED}))


def recognizers_for(*entity_types: str) -> list[Recognizer]:
    """The predefined recognizers of some entity types."""
    unknown = set(entity_types) - set(SUPPORTED_ENTITIES)
    if unknown:
        raise ValueError(f"no predefined recognizer for {sorted(unknown)}")
    return [r for r in PREDEFINED if r.entity_type in entity_types]
