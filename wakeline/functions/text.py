"""Column functions over source text and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
KEYWORDS = tuple("abstract as base bool break byte case catch char class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof static string struct switch this throw true try typeof uint ulong unsafe ushort using var virtual void volatile while async await get set value partial where yield dynamic nameof record init".split())
TYPE_WORDS = ("class", "struct", "interface", "enum", "record")
_DECLARED = rf"\b(?:{'|'.join(TYPE_WORDS)})\s+({IDENTIFIER})"
_DELEGATE = rf"\bdelegate\s+[\w<>\[\],.?]+\s+({IDENTIFIER})"
_IMPORT = r"(?m)^[ \t]*using[ \t]+([A-Za-z_][A-Za-z0-9_.]*)[ \t]*;"
PROCEDURE_PREFIXES = ("sp_", "usp_")
#: Longer suffixes stand before those they end with.
SUFFIXES = (".IntegrationTests", ".UnitTests", ".Tests", ".Test", ".WebApi", ".Service", ".Services", ".Client", ".Worker", ".Host", ".Web", ".Api", ".Core", ".Job")
TEST_GLOBS = ("*.Tests", "*.Test", "*.UnitTests", "*.IntegrationTests", "*Tests", "*Test", "*.Specs", "*.Benchmarks", "*.TestUtilities")
#: What counts as a credential.
CREDENTIALS = (
    ("AWS access key", r"AKIA[0-9A-Z]{16}"),
    ("private key", r"-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----"),
    ("connection string", r"(?i)(?:connection\s*string|data\s+source)\s*=\s*[\"']?[^\s;\"']{10,}"),
    ("password assignment", r"(?i)(?:password|passwd|pwd)\s*=\s*[\"'][^\"']{4,}[\"']"),
    ("API key assignment", r"(?i)(?:api[_-]?key|apikey|secret[_-]?key)\s*=\s*[\"'][^\"']{8,}[\"']"),
)


def identifiers(text: Column) -> Column:
    """Sorted distinct identifiers that aren't keywords."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"))), F.array(*map(F.lit, KEYWORDS))))


def declared_types(text: Column) -> Column:
    """Declared type names, delegates last, each once."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(_DECLARED)), F.regexp_extract_all(text, F.lit(_DELEGATE))))


def declared_kinds(text: Column) -> Column:
    """(name, kind) of each declaration, first one wins by name."""
    kinds = F.regexp_extract_all(text, F.lit(_DECLARED.replace("(?:", "(", 1)), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(_DECLARED.replace("(?:", "(", 1)), F.lit(2))
    pairs = F.zip_with(names, kinds, lambda n, k: F.struct(n.alias("name"), k.alias("kind")))
    others = F.transform(F.regexp_extract_all(text, F.lit(_DELEGATE)), lambda n: F.struct(n.alias("name"), F.lit("delegate").alias("kind")))
    found = F.concat(pairs, others)
    names = F.transform(found, lambda x: x["name"])
    return F.filter(found, lambda x, i: F.array_position(names, x["name"]) == i + 1)


def imported_namespaces(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(_IMPORT)), lambda x: x != "static")))


def procedure_names(text: Column, prefixes: tuple[str, ...] = PROCEDURE_PREFIXES) -> Column:
    """Names in quotes that start with one of the prefixes, with an optional schema."""
    start = "|".join(map(re.escape, prefixes))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?i)\"((?:\[?\w+\]?\.)?\[?(?:{start})\w+\]?)\""))))


def strip_comments(text: Column) -> Column:
    """Without // and /* */ comments; strings, verbatim strings and character literals keep theirs.

    A block comment is replaced by its line breaks, so line numbers stay.
    """
    literal = r"""@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
    # comments are set between marks by one scan that steps over literals; every second piece is then a comment
    marked = F.regexp_replace(text, rf"(?s)({literal})|(//[^\n]*|/\*.*?(?:\*/|\z))", "\u0002$1\u0001$2\u0001")
    marked = F.regexp_replace(marked, "\u0001\u0001", "")
    pieces = F.split(F.replace(marked, F.lit("\u0002"), F.lit("")), "\u0001")
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.regexp_replace(p, r"[^\n]", ""))), "")


def code_only(text: Column) -> Column:
    """Text with comments and literals blanked out."""
    return F.regexp_replace(text, r"""(?s)@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|//[^\n]*|/\*.*?(?:\*/|\z)""", " ")


def normalize_procedure(name: Column) -> Column:
    """Without brackets and blanks around dots; the schema in lower case, the name as it is."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(name), r"[\[\]]", ""), r"\s*\.\s*", ".")
    parts = F.split(bare, r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.concat(F.lower(F.array_join(F.slice(parts, F.lit(1), n - 1), ".")), F.lit("."), F.get(parts, n - 1))).otherwise(bare)


def line_number(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def classify_path(path: Column) -> Column:
    """'test' by a directory or a file name that says so, else 'production'."""
    test = path.rlike(r"(?i)(^|/)(test|tests|testing)/") | path.rlike(r"(^|/)([^/]*(Tests?|Specs?)\.[^/]*|test_[^/]*|[^/]*_test\.[^/]*|[^/]*\.test\.[^/]*)$")
    return F.when(test, "test").otherwise("production")


def strip_suffix(name: Column) -> Column:
    """Without the first of SUFFIXES that ends the name, whatever its case."""
    return F.regexp_replace(name, rf"(?i)({'|'.join(map(re.escape, SUFFIXES))})$", "")


def matches_glob(name: Column, globs: tuple[str, ...] = TEST_GLOBS) -> Column:
    return name.rlike("^(?:" + "|".join(re.escape(g).replace(r"\*", ".*").replace(r"\?", ".") for g in globs) + ")$")


def redact(text: Column) -> Column:
    """Each line with a credential is replaced by a marker of its first matching kind."""

    def one(line: Column) -> Column:
        out = line
        for kind, pattern in reversed(CREDENTIALS):
            out = F.when(line.rlike(pattern), F.lit(f"[removed: {kind}]")).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")


def set_hash(names: Column) -> Column:
    """SHA-256 of the sorted names, one a line."""
    return F.sha2(F.array_join(F.array_sort(names), "\n"), 256)


def ancestors(path: Column) -> Column:
    """Every directory above a path, nearest first, without the empty root."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def dotted_prefixes(name: Column) -> Column:
    """Every proper prefix at a dot, longest first."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).otherwise(F.array().cast("array<string>"))


def normalize_path(path: Column) -> Column:
    """With forward slashes, without . and name/.. steps."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != ".") & (x != ""))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(walked, "/"))
