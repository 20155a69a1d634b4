"""Column functions on cell texts: types, numbers, labels.  All are expressions that Spark compiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the cell types, in the order in which they are tried.
CELL_PATTERNS = [
    ("currency", r"^(₩\s*[0-9,]+|[0-9,]+\s*원)$"),
    ("percent", r"^[+-]?[0-9]+\.?[0-9]*\s*%$"),
    ("date", r"^[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}$"),
    ("number", r"^[+-]?[0-9,]+\.?[0-9]*$"),
]
#: Number formats of the sheet profiles.
NUMBER_FORMATS = {"default": "#,##0", "demand_forecast": "#,##0;[Red]\\-#,##0;\\-;"}
HEADER_FORMATS = {"default": "#,##0", "demand_forecast": "\\+#,##0;\\-#,##0"}
#: What a plain number looks like; casts are guarded by it because Spark also takes "1d".
PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it."""
    return F.transform(F.array(c), f)[0]


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; every cell passes here, and a trim costs a fraction of a pattern."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def plain_number(c: Column) -> Column:
    return F.when(c.rlike(PLAIN), c.try_cast("double"))


def cell_type(c: Column) -> Column:
    """currency, percent, date, number or text."""
    v = strip(c)
    out = F.when(v == "", "text")
    for name, pattern in CELL_PATTERNS:
        out = out.when(v.rlike(pattern), name)
    return out.otherwise("text")


def parse_numeric(c: Column) -> Column:
    """The number a cell shows, without currency marks, percent signs and commas; null if there is none."""
    v = F.rtrim(F.translate(c, "₩원 \t\n\x0b\f\r", ""), F.lit("%"))  # a fraction of what patterns cost
    return plain_number(F.replace(v, F.lit(","), F.lit("")))


def safe_float(c: Column) -> Column:
    """A lenient float: commas are dropped, currency and percent are not known."""
    return plain_number(F.replace(strip(c), F.lit(","), F.lit("")))


def unparsable(c: Column) -> Column:
    """A cell that looks like a number and is none."""
    return cell_type(c).isin("currency", "percent", "number") & parse_numeric(c).isNull()


def fix_digits(c: Column) -> Column:
    """Letters that were misread for digits."""
    return F.translate(c, "OolISBZG", "00115826")  # fixed values


def fix_numeric(h: Column, c: Column) -> Column:
    """Letters for digits in columns whose header says that they hold numbers; other cells stay as they are."""
    s = strip(c)
    fixed = fix_digits(s)
    return F.when(numeric_header(h) & (s != "") & (fixed != s), fixed).otherwise(c)


def numeric_header(h: Column) -> Column:
    return strip(h).rlike("^[+-]*[0-9]+$") | h.contains("금액") | h.contains("합계")


def spread_header(h: Column, idx: Column) -> Column:
    """A placeholder, a signed number from the sixth column on, or a number in the last parentheses."""
    s = strip(h)
    bare = F.regexp_replace(F.regexp_replace(s, "^[+-]+", ""), "[.%]", "")
    inner = F.regexp_replace(strip(F.regexp_extract(s, r".*\(([^)]*)\)[^()]*$", 1)), "^[+-]+|[.]", "")
    return s.rlike("^Col_[0-9]+$") | (bare.rlike("^[0-9]+$") & (idx >= 5)) | inner.rlike("^[0-9]+$")


def spread_number(h: Column) -> Column:
    """A name that is a number, or whose part between the last parentheses is one; signs in front, points and (outside parentheses) percent signs do not count.

    Unlike :func:`spread_header`, a placeholder is none, and the column's place does not matter.
    """
    s = strip(h)
    digits = lambda t, also: t.rlike(f"^[+-]*[{also}]*[0-9][0-9{also}]*$")
    inner = strip(F.regexp_extract(s, r"\(([^(]*)\)[^()]*$", 1))
    return F.when(s.contains("("), digits(inner, ".") | digits(s, ".%")).otherwise(digits(s, ".%"))


def total_header(h: Column) -> Column:
    return h.contains("총참여") | h.contains("참여금액")


def row_type(c: Column) -> Column:
    """Role of a row by its first cell."""
    v = strip(c)
    return (
        F.when(v == "", "normal")
        .when(v.isin("구 분", "구분"), "header")
        .when(v.isin("비중(%)", "비중", "누적비중(%)", "누적비중"), "summary")
        .when(v.rlike("총계|합계|소계"), "subtotal")
        .when(v.rlike(r"^\[.+\]$"), "category")
        .when(v.rlike(r"^[ㆍ·•-]"), "detail")
        .when(v.contains("년") & (v.contains("월") | v.contains("기")), "period")
        .otherwise("normal")
    )


def column_kind(h: Column, numbers: Column) -> Column:
    """Kind of a column by its header, else by how many of its first five values are numbers."""
    s = strip(h)
    return (
        F.when(s.rlike("회사|기관"), "company").when(s.rlike("부서|팀"), "department").when(s.rlike("이름|성명"), "name").when(s.contains("계정"), "account")
        .when(s.rlike("일시|날짜"), "datetime").when(s.rlike("^[+-]*[0-9]+$") | s.rlike("금액|합계"), "number").when(numbers >= 3, "number").otherwise("text")
    )


def correction_kind_by_header(h: Column, original: Column) -> Column:
    s = F.lower(h)
    digits = F.regexp_replace(original, "[,-]", "").rlike("^[0-9]+$")
    return (
        F.when(s.rlike("회사|기관"), "company").when(s.rlike("부서|팀"), "department").when(s.rlike("이름|성명"), "name")
        .when(s.rlike("날짜|일시|참여일"), "date").when(s.rlike("금액|합계"), "number").when(digits, "number").otherwise("term")
    )


def correction_kind_by_value(wrong: Column, correct: Column) -> Column:
    return (
        F.when(correct.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").when(correct.rlike(r"^[0-9]+\.?[0-9]*$"), "number")
        .when(correct.rlike("운용|증권|보험|은행|투자|자산"), "company").when((F.length(wrong) <= 4) & (F.length(correct) <= 4), "name").otherwise("term")
    )


def display_width(c: Column) -> Column:
    """Width in a sheet: characters beyond ASCII count twice."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))


def jamo(c: Column) -> Column:
    """Hangul syllables as compatibility letters (initial, vowel, final if any); other characters as they are."""
    initial, vowel, final = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ", "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"

    def parts(ch: Column) -> Column:
        n = F.ascii(ch) - 0xAC00
        last = F.when(n % 28 > 0, F.substr(F.lit(final), n % 28, F.lit(1))).otherwise("")
        return F.when((n >= 0) & (n < 11172), F.concat(F.substr(F.lit(initial), F.floor(n / 588).cast("int") + 1, F.lit(1)), F.substr(F.lit(vowel), F.floor(n % 588 / 28).cast("int") + 1, F.lit(1)), last)).otherwise(ch)

    return F.when(c == "", "").otherwise(F.array_join(F.transform(F.split(c, ""), parts), ""))


def jamo_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(jamo(a), jamo(b))


def tokens(c: Column) -> Column:
    """Words of two or more characters without the fixed stop words."""
    stop = ["은", "는", "이", "가", "을", "를", "의", "에", "서", "도", "로", "와", "과", "으로"]  # fixed values
    words = F.split(F.regexp_replace(c, r"[^\p{L}\p{N}_]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(stop))


def mime_type(ext: Column) -> Column:
    return F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext.isin("png", "bmp", "webp", "gif"), F.concat(F.lit("image/"), ext)).when(ext.isin("tif", "tiff"), "image/tiff").otherwise("image/png")


def route(path: Column) -> Column:
    """image, pdf or unsupported, by extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("png", "jpg", "jpeg", "bmp", "tiff", "tif", "webp"), "image").when(ext == "pdf", "pdf").otherwise("unsupported")


def repair_json(c: Column) -> Column:
    """Cut after the last ``]`` (unless that is the first character) and close what is open: brackets first, then braces."""

    def cut(s: Column) -> Column:
        last = F.length(s) - F.length(F.substring_index(s, "]", -1))
        return F.when((F.instr(s, "]") > 0) & (last > 1), F.substr(s, F.lit(1), last)).otherwise(s)

    missing = lambda s, left, right: F.greatest(F.length(F.replace(s, F.lit(right), F.lit(""))) - F.length(F.replace(s, F.lit(left), F.lit(""))), F.lit(0))
    return bound(c, lambda s: bound(cut(s), lambda t: F.concat(t, F.repeat(F.lit("]"), missing(t, "[", "]")), F.repeat(F.lit("}"), missing(t, "{", "}")))))


def cell_plan(c: Column, number_format: str | Column = "#,##0", parsed: Column | None = None) -> Column:
    """What a sheet's cell holds: number and format, or the text as it is; ``parsed`` is its :func:`parse_numeric` where that is known."""
    parsed, point = parse_numeric(c) if parsed is None else parsed, c.contains(".")
    percent = c.contains("%") & strip(c).rlike(dict(CELL_PATTERNS)["percent"])  # no other type has a percent sign
    number = F.when(percent, parsed / 100).when(point, parsed).otherwise(F.coalesce(parsed.try_cast("bigint").cast("double"), parsed))
    fmt = F.when(parsed.isNull(), "General").when(percent, "0.0%").when(point, "#,##0.00").otherwise(number_format)
    return F.struct(F.when(parsed.isNotNull(), number).alias("number"), F.when(parsed.isNull(), c).alias("string_value"), fmt.alias("fmt"))


def column_width(widest: Column, idx: Column, demand: bool) -> Column:
    """Width of a sheet's column from its widest text; ``idx`` counts from 0.  Fixed values."""
    if demand:
        return F.greatest(widest + F.when(idx < 6, 3).otherwise(2), F.when(idx < 6, 14).otherwise(7))
    return F.greatest(widest + F.when(idx == 0, 4).otherwise(3), F.when(idx == 0, 30).otherwise(18))


def output_path(path: Column) -> Column:
    """Where the sheets of a file go: its name without extension and a fixed ending."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("_변환결과.xlsx"))


def normal_label(c: Column) -> Column:
    """A label for comparison: without commas, spaces, brackets and middle dots."""
    return strip(F.translate(c, ", []·ㆍ", ""))
