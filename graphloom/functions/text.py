"""Text functions as Column expressions: case splitting, folding, tokens, structure, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"[A-Za-zА-Яа-яЁё0-9_]+"
# Words left out of every search, and those left out of a search of code besides.
STOP_WORDS = (
    "как", "где", "что", "чтобы", "если", "или", "для", "при", "это",
    "этот", "эта", "эти", "этой", "этого", "будет", "есть", "нет",
    "надо", "нужно", "который", "которая", "которые", "каких", "каким",
    "какие", "по", "из", "на", "в", "с", "к", "от", "до", "и", "а",
    "же", "ли", "не", "за", "под", "над", "через", "между",
)
CODE_STOP_WORDS = STOP_WORDS + (
    "тогда", "иначе", "иначеесли", "конецесли", "каждого", "цикл", "конеццикла", "пока",
    "попытка", "исключение", "конецпопытки", "возврат", "перем", "знач", "экспорт", "новый",
    "истина", "ложь", "неопределено", "null", "true", "false",
    "procedure", "function", "endprocedure", "endfunction",
    "if", "then", "else", "elsif", "endif",
    "for", "each", "while", "return", "export", "new",
)
# Endings taken off a word, in the order in which they are tried.
ENDINGS = (
    "иями", "ями", "ами", "ого", "ему", "ыми", "ими",
    "иях", "иям", "ией", "ию", "ия",
    "ые", "ие", "ой", "ий", "ый", "ая", "яя", "ое", "ее", "ую", "юю",
    "ов", "ев", "ам", "ям", "ах", "ях", "ом", "ем", "ей", "ою", "ею",
    "ы", "и", "а", "я", "е", "у", "ю",
)


def word_split(text: Column) -> Column:
    """A blank between a small letter or digit and a capital: the split that tokens start from (ё and Ё don't count)."""
    return F.regexp_replace(text, "(?<=[а-яa-z0-9])(?=[А-ЯA-Z])", " ")


def camel_split(text: Column) -> Column:
    """A blank between a small letter or digit and a capital, and before the last of several capitals."""
    once = F.regexp_replace(text, r"([a-zа-яё0-9])([A-ZА-ЯЁ])", "$1 $2")
    return F.regexp_replace(once, r"([A-ZА-ЯЁ])([A-ZА-ЯЁ][a-zа-яё])", "$1 $2")


def folded(text: Column) -> Column:
    """Lower case, ё as е, without blanks, underscores and hyphens."""
    return F.translate(F.lower(text), "ё _-", "е")


def last_part(text: Column, separator: str = ".") -> Column:
    """What follows the last separator."""
    return F.substring_index(text, separator, -1)


def tokens(text: Column, least: int = 3, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Split at capitals, lower case, words of letters, digits and underscores, short ones and stop words left out."""
    words = F.regexp_extract_all(F.lower(word_split(text)), F.lit(f"({_WORD})"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop))


def stem(word: Column, least: int = 4) -> Column:
    """The form under which words are compared: lower case without underscores; a Cyrillic word of more than
    ``least`` letters also loses the first ending of the list that leaves at least ``least``."""
    bare = F.replace(F.lower(word), F.lit("_"), F.lit(""))
    shorter = [F.when(bare.endswith(e) & (F.length(bare) - len(e) >= least), F.left(bare, F.length(bare) - len(e))) for e in ENDINGS]
    return F.when(bare.rlike("^[а-яё]+$") & (F.length(bare) > least), F.coalesce(*shorter, bare)).otherwise(bare)


def overlap(query: Column, document: Column) -> Column:
    """Share of the distinct query tokens that the document has; 0 for an empty query."""
    size = F.size(F.array_distinct(query))
    return F.when(size > 0, F.size(F.array_intersect(query, document)) / size).otherwise(0.0)


def quoted(text: Column) -> Column:
    """Phrases between quotation marks of any kind, the shortest that fit; an opening mark need not match the closing one."""
    return F.regexp_extract_all(text, F.lit("[\"'«“](.+?)[\"'»”]"), F.lit(1))


def synonym_tokens(words: Column, synonyms: dict[str, list[str]], weight: int = 1) -> Column:
    """Query tokens followed by their synonyms' tokens, each ``weight`` times unless it is a query token itself.

    ``synonyms`` is a small table of the caller's; the synonyms are tokens already.
    """
    if weight <= 0 or not synonyms:
        return words
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    more = F.flatten(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), F.array().cast("array<string>"))))
    more = F.filter(more, lambda s: ~F.array_contains(words, s))
    return F.concat(words, F.flatten(F.transform(more, lambda s: F.array_repeat(s, weight))))


def fts_terms(query: Column, most: int = 12) -> Column:
    """Terms of a full-text query: split at blanks, operators in them as blanks, lower case, of three letters and more, distinct, at most ``most``."""
    bare = F.transform(F.split(F.trim(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: F.lower(F.trim(F.translate(w, "\"'()[]{}:^*+-", " " * 13))))
    return F.slice(F.array_distinct(F.filter(bare, lambda w: F.length(w) >= 3)), 1, most)


def escaped(query: Column) -> Column:
    """A query text with the operators of a Lucene-like parser escaped."""
    return F.regexp_replace(query, r'([+\-!(){}\[\]^"~*?:\\/]|&&|\|\|)', r"\\$1")


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case: a necessary condition of containment."""
    low = F.lower(text)
    return F.when(F.length(low) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))))


def split_params(params: Column) -> Column:
    """A parameter list split at its commas, those in strings and brackets left alone, each part trimmed; no parts of an empty list."""
    parts = F.regexp_extract_all(params, F.lit(r'((?:"[^"]*+"|\((?:[^()"]*+|"[^"]*+")*+\)|[^,"()]++)++)'), F.lit(1))
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")


def param_facts(param: Column) -> Column:
    """(name, by_value, default) of one parameter."""
    name = F.regexp_extract(param, r"(?iu)^(?:(?:знач|val)\s+)?([\p{L}_][\p{L}\p{N}_]*)", 1)
    default = F.when(param.contains("="), F.trim(F.regexp_extract(param, r"(?s)=\s*(.*)$", 1)))
    return F.struct(name.alias("name"), param.rlike(r"(?iu)^(?:знач|val)\s").alias("by_value"), default.alias("default"))


def owner_parts(qn: Column) -> Column:
    """(project, config, type, object, form) of a qualified name; parts that aren't there are null."""
    at = F.split(qn, "/")
    form = F.when(F.lower(F.get(at, F.lit(4))).isin("form", "forms"), F.get(at, F.lit(5)))
    return F.struct(F.get(at, F.lit(0)).alias("project"), F.get(at, F.lit(1)).alias("config"), F.get(at, F.lit(2)).alias("type"), F.get(at, F.lit(3)).alias("object"), form.alias("form"))


def doc_sections(doc: Column) -> Column:
    """(description, params, returns) of a documentation text, cut at the headings of its sections."""
    text = F.regexp_replace(doc, r"(?m)^[ \t]*/{2,}[ \t]?", "")
    params, returns = r"(?imu)^[ \t]*(?:параметры|parameters)[ \t]*:", r"(?imu)^[ \t]*(?:возвращаемое значение|return value|returns)[ \t]*:"
    part = lambda s: F.nullif(F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")), F.lit(""))
    any_head = rf"(?:{params.replace('(?imu)', '')}|{returns.replace('(?imu)', '')})"
    body = lambda head: F.regexp_extract(text, rf"(?imu){head.replace('(?imu)', '')}((?s:.*?))(?={any_head}|\z)", 1)
    return F.struct(part(F.get(F.split(text, rf"(?imu){any_head}"), F.lit(0))).alias("description"), part(body(params)).alias("params"), part(body(returns)).alias("returns"))


def code_facts(code: Column) -> Column:
    """Counts of what a body does: (lines, branches, loops, tries, returns, queries, calls)."""
    bare = F.regexp_replace(F.coalesce(code, F.lit("")), r'"[^"]*+(?:""[^"]*+)*+"|//[^\r\n]*+', "")
    word = lambda pattern: F.size(F.regexp_extract_all(bare, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_.])({pattern})(?![\p{{L}}\p{{N}}_])"), F.lit(1)))
    lines = F.when(F.coalesce(code, F.lit("")) == "", 0).otherwise(F.size(F.split(code, "\n")))
    return F.struct(
        lines.alias("lines"), word("если|иначеесли|if|elsif").alias("branches"), word("для|пока|for|while").alias("loops"), word("попытка|try").alias("tries"),
        word("возврат|return").alias("returns"), F.size(F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(r"(?iu)[\"|]\s*(выбрать|select)\b"), F.lit(1))).alias("queries"),
        F.size(called_names(bare)).alias("calls"),
    )


def type_refs(literal: Column) -> Column:
    """[(category, name)] of the metadata types that a type literal names: ``КатегорияСсылка.Имя`` and English likewise."""
    found = F.regexp_extract_all(literal, F.lit(r"(?u)([\p{L}]+(?:Ссылка|Ref|Объект|Object|НаборЗаписей|RecordSet|Тип|Type)?\.[\p{L}_][\p{L}\p{N}_]*)"), F.lit(1))
    return F.transform(found, lambda t: F.struct(F.regexp_replace(F.substring_index(t, ".", 1), "(Ссылка|Ref|Объект|Object|НаборЗаписей|RecordSet)$", "").alias("category"), F.substring_index(t, ".", -1).alias("name")))


def distinct_first(items: Column, most: int) -> Column:
    """The distinct items in order, at most ``most``."""
    return F.slice(F.array_distinct(items), 1, most)


def called_names(code: Column) -> Column:
    """Names that stand before an opening bracket."""
    return F.regexp_extract_all(code, F.lit(r"(?<![A-Za-zА-Яа-яЁё_])([A-Za-zА-Яа-яЁё_][A-Za-zА-Яа-яЁё0-9_]*+)\s*+\("), F.lit(1))


def assigned_names(code: Column) -> Column:
    """Names on the left of an assignment at the start of a line."""
    return F.regexp_extract_all(code, F.lit(r"(?m)^[ \t]*([A-Za-zА-Яа-яЁё_][A-Za-zА-Яа-яЁё0-9_]*)[ \t]*="), F.lit(1))


def string_literals(code: Column) -> Column:
    """String literals of 3 to 160 characters with a letter."""
    found = F.regexp_extract_all(code, F.lit(r'"([^"\r\n]{3,160})"'), F.lit(1))
    return F.filter(found, lambda s: s.rlike(r"[A-Za-zА-Яа-яЁё]"))


def body_slice(text: Column, offset: int, limit: int) -> Column:
    """``limit`` characters from a 0-based offset."""
    return F.substring(text, offset + 1, limit)


def lines_of(text: Column, first: Column, last: Column) -> Column:
    """The lines from ``first`` to ``last``, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def windows(text: Column, size: int, step: int) -> Column:
    """(part, char_start, piece): windows of ``size`` characters, ``step`` apart."""
    count = F.greatest(F.ceil((F.length(text) - (size - step)) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("part"), (i * step).alias("char_start"), F.substring(text, i * step + 1, F.lit(size)).alias("piece")))


def number_ranges(numbers: Column) -> Column:
    """Sorted distinct integers as text: runs as ``1..5``, single ones as they are, joined by ``|``."""
    start = F.struct(F.lit("").alias("done"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))

    def shown(s: Column) -> Column:
        run = F.when(s["a"] == s["b"], s["a"].cast("string")).otherwise(F.concat(s["a"].cast("string"), F.lit(".."), s["b"].cast("string")))
        return F.when(s["a"].isNull(), s["done"]).when(s["done"] == "", run).otherwise(F.concat_ws("|", s["done"], run))

    def step(s: Column, x: Column) -> Column:
        goes_on = s["b"].isNotNull() & (x == s["b"] + 1)
        return F.struct(F.when(goes_on, s["done"]).otherwise(shown(s)).alias("done"), F.when(goes_on, s["a"]).otherwise(x).alias("a"), x.alias("b"))

    return F.aggregate(F.array_sort(F.array_distinct(numbers.cast("array<bigint>"))), start, step, shown)


# Named characters of HTML that texts in Russian, English and German use.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "laquo": "«", "raquo": "»", "ldquo": "“", "rdquo": "”", "bdquo": "„", "lsquo": "‘", "rsquo": "’", "mdash": "—", "ndash": "–", "hellip": "…", "bull": "•",
    "sect": "§", "copy": "©", "reg": "®", "deg": "°", "times": "×", "plusmn": "±", "euro": "€", "shy": "", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é",
}


def characters(text: Column) -> Column:
    """A text with its character references, named or numbered, taken back; unknown ones stay, ``&amp;`` is the last."""
    table = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit("(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});)"), F.lit(1))), lambda e: e != "&amp;")

    def meant(e: Column) -> Column:
        name = F.regexp_replace(e, "[&;]", "")
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2))).try_cast("int")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        numbered = F.when(name.startswith("#") & valid, F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32"))
        return F.coalesce(numbered, F.element_at(table, name), e)

    plain = F.aggregate(found, text, lambda t, e: F.replace(t, e, meant(e)))
    return F.when(text.contains("&"), F.replace(plain, F.lit("&amp;"), F.lit("&"))).otherwise(text)


def html_text(html: Column) -> Column:
    """Visible text of HTML: scripts, styles, comments and tags out, character references back, blanks joined."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = characters(F.regexp_replace(bare, r"(?s)<[^>]+>", " "))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def clean(text: Column) -> Column:
    """A text on one line: line ends and runs of blanks as one blank, none at its ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def same_words(a: Column, b: Column) -> Column:
    """Whether two names are the same but for case, ё, blanks and signs: a synonym that repeats its name."""
    key = lambda c: F.lower(F.translate(F.regexp_replace(clean(c), "[^0-9A-Za-zА-Яа-яЁё]+", ""), "ёЁ", "еЕ"))
    return (key(a) != "") & (key(a) == key(b))


# Short forms of types.
TYPE_ALIASES = {
    "Число": "Ч", "Строка": "С", "Дата": "Д", "Булево": "Б", "СправочникСсылка": "СС", "ДокументСсылка": "ДС", "ПеречислениеСсылка": "ПС",
    "ПланВидовРасчетаСсылка": "ПВРС", "ПланВидовХарактеристикСсылка": "ПВХС", "ОпределяемыйТип": "ОТ",
}


def short_type(literal: Column) -> Column:
    """A type literal with its first part in short form."""
    table = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    head = F.substring_index(literal, ".", 1)
    return F.concat(F.coalesce(F.element_at(table, head), head), F.substr(literal, F.length(head) + 1))


def short_union(types: Column) -> Column:
    """A list of types as one text: those of one kind in brackets behind its short form, plain ones after them, joined by ``|``."""
    named = F.filter(types, lambda t: t.contains("."))
    heads = F.array_distinct(F.transform(named, lambda t: F.substring_index(t, ".", 1)))
    table = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])

    def group(h: Column) -> Column:
        names = F.array_distinct(F.transform(F.filter(named, lambda t: F.substring_index(t, ".", 1) == h), lambda t: F.substr(t, F.length(h) + 2)))
        short = F.coalesce(F.element_at(table, h), h)
        return F.when(F.size(names) == 1, F.concat(short, F.lit("."), F.element_at(names, 1))).otherwise(F.concat(short, F.lit(".("), F.array_join(names, "|"), F.lit(")")))

    plain = F.transform(F.filter(types, lambda t: ~t.contains(".")), lambda t: F.coalesce(F.element_at(table, t), t))
    return F.array_join(F.concat(F.transform(heads, group), plain), "|")


def numbered(name: Column) -> Column:
    """(prefix, number, suffix) of a name with exactly one run of digits, null otherwise."""
    parts = F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0))
    return F.when(
        F.size(parts) == 1,
        F.struct(F.regexp_extract(name, r"^(\D*)\d+", 1).alias("prefix"), F.element_at(parts, 1).cast("long").alias("number"), F.regexp_extract(name, r"\d+(\D*)$", 1).alias("suffix")),
    )


def segments(code: Column) -> Column:
    """(regions, comments, headers, directives) of a module's text, each as a list in order."""
    all_of = lambda pattern, group=1: F.regexp_extract_all(code, F.lit(pattern), F.lit(group))
    return F.struct(
        all_of(r"(?imu)^[ \t]*#(?:область|region)[ \t]+([\p{L}_][\p{L}\p{N}_]*)").alias("regions"), all_of(r"(?m)//[ \t]*([^\r\n]*)").alias("comments"),
        all_of(r"(?imu)^[ \t]*((?:процедура|функция|procedure|function)[ \t]+[\p{L}_][\p{L}\p{N}_]*)").alias("headers"), all_of(r"(?mu)^[ \t]*(&[\p{L}]+)").alias("directives"),
    )


def weighted_text(parts: list[tuple[Column, int]]) -> Column:
    """Texts laid one after another, each as often as its weight says, empty ones left out."""
    whole = [F.array_join(F.array_repeat(c, w), " ") for c, w in parts]
    return F.array_join(F.filter(F.array(*whole), lambda t: t.isNotNull() & (F.trim(t) != "")), " ")


def context_prefix(kind: Column, object_name: Column, form: Column, symbol: Column) -> Column:
    """Comment lines that tell where code stands: ``//Kind.Object[.Form]`` and ``//Symbol``; empty parts are left out."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    place = F.when((text(kind) != "") & (text(object_name) != ""), F.concat(F.lit("//"), text(kind), F.lit("."), text(object_name), F.when(text(form) != "", F.concat(F.lit("."), text(form))).otherwise("")))
    lines = F.filter(F.array(place, F.when(text(symbol) != "", F.concat(F.lit("//"), text(symbol)))), lambda x: x.isNotNull())
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")


def qualified(*parts: Column | str) -> Column:
    """A qualified name of its parts, null if any is missing."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    missing = F.lit(False)
    for c in columns:
        missing = missing | c.isNull()
    return F.when(~missing, F.concat_ws("/", *columns))


def unwrapped(literal: Column) -> Column:
    """The type literals inside containers like ``Массив<Тип>`` or ``Array of T``, qualifiers in brackets taken off; a plain literal gives itself."""
    bare = F.regexp_replace(literal, r"\([^()]*\)", "")
    inner = F.regexp_replace(bare, r"(?iu)^\s*(?:массив|список|array|list)\s*(?:<\s*|\s+(?:из|of)\s+)(.*?)>?\s*$", "$1")
    return F.filter(F.transform(F.split(inner, r"[|,;]"), lambda t: F.trim(t)), lambda t: t != "")


# English heads of type literals and their Russian forms.
TYPE_HEADS = {
    "Catalog": "Справочник", "Document": "Документ", "Enum": "Перечисление", "ChartOfCharacteristicTypes": "ПланВидовХарактеристик", "ChartOfAccounts": "ПланСчетов", "BusinessProcess": "БизнесПроцесс", "Task": "Задача",
    "ExchangePlan": "ПланОбмена", "InformationRegister": "РегистрСведений", "AccumulationRegister": "РегистрНакопления", "Report": "Отчет", "DataProcessor": "Обработка", "DefinedType": "ОпределяемыйТип",
}
TYPE_TAILS = {"Ref": "Ссылка", "Object": "Объект", "RecordSet": "НаборЗаписей", "Manager": "Менеджер"}
PLAIN_TYPES = {"string": "Строка", "decimal": "Число", "boolean": "Булево", "dateTime": "Дата", "ValueStorage": "ХранилищеЗначения"}


def russian_type(literal: Column) -> Column:
    """A type literal with its English parts in Russian; Russian and unknown ones stay as they are."""
    names = {h + t: r + q for h, r in TYPE_HEADS.items() for t, q in {**TYPE_TAILS, "": ""}.items()} | PLAIN_TYPES
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    head = F.substring_index(literal, ".", 1)
    return F.concat(F.coalesce(F.element_at(table, head), head), F.substr(literal, F.length(head) + 1))


def embedded_queries(code: Column) -> Column:
    """The query texts in the literals of code: line continuations and doubled quotes taken back, literals that start with no query left out."""
    found = F.regexp_extract_all(code, F.lit(r'"((?iu:[\s|]*+(?:выбрать|select)\b)[^"]*+(?:""[^"]*+)*+)"'), F.lit(1))
    return F.transform(found, lambda q: F.trim(F.replace(F.regexp_replace(q, r"(?m)^[ \t]*\|", ""), F.lit('""'), F.lit('"'))))


def query_parts(query: Column) -> Column:
    """The parts of a query text, cut at its statements and unions."""
    return F.filter(F.transform(F.split(query, r"(?iu);|\b(?:объединить(?:\s+все)?|union(?:\s+all)?)\b"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
