"""Line-first cleaning: rules per line, then documents that lose too much text. DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.scale import let
from siltworks.llm.text import words

WINDOW = 5


@dataclass(frozen=True)
class LineRules:
    """What fails a line, and how much text a document may lose.

    A line fails by punctuation if more than ``max_symbol_share`` of its characters are ``#*$%&|<>{}~^\\_=``
    or ``!``, or if it has at most ``max_open_words`` words and no closing mark; by navigation if it has ``min_separators`` menu
    separators and they are ``min_separator_share`` of its words or more, or if it is a short line that starts with a menu word and has no closing
    mark; by boilerplate if a short line holds one of the stock phrases.
    """

    max_symbol_share: float = 0.1
    max_open_words: int = 3
    min_separators: int = 2
    min_separator_share: float = 0.2
    max_menu_words: int = 8
    max_boiler_words: int = 30
    min_kept_share: float = 0.5


SYMBOLS = r"[#*$%&|<>{}~^\\_=!]"
CLOSED = r"[.!?:;,…。！？؟।][\"'”’»)\]]*$"
SEPARATOR = r"( [|»›•·>/] )"
#: How menu lines begin and what boilerplate says, in English, German, French and Spanish. A dot stands for
#: an accented letter, whose case the engines fold differently.
MENU = (
    r"(?i)^(home|menu|log ?in|sign ?(in|up)|register|contact( us)?|about( us)?|site ?map|search|next|previous|"
    r"back to top|skip to|share|tweet|print|read more|subscribe|"
    r"startseite|suche|anmelden|abmelden|registrieren|kontakt|impressum|weiterlesen|nach oben|teilen|drucken|"
    r"accueil|recherche|connexion|s'inscrire|contactez|plan du site|lire la suite|partager|imprimer|"
    r"inicio|buscar|iniciar|registrarse|contacto|mapa del sitio|leer m.s|compartir|imprimir)\b"
)
BOILER = (
    r"(?i)(all rights reserved|terms of (use|service)|privacy policy|use cookies|cookie policy|enable javascript|"
    r"lorem ipsum|powered by|click here|page not found|©|\(c\) \d{4}|"
    r"alle rechte vorbehalten|datenschutzerkl.rung|verwendet cookies|nutzungsbedingungen|seite nicht gefunden|"
    r"tous droits r.serv.s|politique de confidentialit|utilise des cookies|conditions d'utilisation|page introuvable|"
    r"todos los derechos reservados|pol.tica de privacidad|utiliza cookies|condiciones de uso|p.gina no encontrada)"
)


def base_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols and n_dup_lines of a text; null has none."""
    safe = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(safe, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": (F.length(safe) - F.length(F.regexp_replace(safe, "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def repeated_words(w: Column) -> Column:
    """Words inside windows of five that occur twice or more in the text.

    Windows are 64-bit hashes of word hashes. Only if any repeats are they sorted with their places.
    Linear space and n log n time, whatever the text repeats. Arrays are bound as variables, so that no
    rewrite of the plan evaluates them once an element.
    """

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda s, x: s + x)

    def places(pairs: Column) -> Column:
        twin = F.filter(
            pairs,
            lambda x, i: F.coalesce(F.get(pairs, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False)),
        )
        return let(F.array_sort(F.transform(twin, lambda x: x["p"])), covered)

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, p: F.struct(x.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, places))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    found = let(hashed, lambda h: F.when(F.size(h) <= WINDOW, F.lit(0)).otherwise(let(windows(h), count)))
    return found.cast("long")


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line with words breaks a punctuation, navigation or boilerplate rule; blank lines break none."""

    def broken(n: Column) -> Column:
        open_end = ~F.rtrim(line).rlike(CLOSED)
        symbols = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))
        punctuation = ((n <= rules.max_open_words) & open_end) | (symbols > F.lit(rules.max_symbol_share) * F.length(line))
        few = n <= rules.max_menu_words
        separated = let(
            F.size(F.split(line, SEPARATOR)) - 1,
            lambda k: (k >= rules.min_separators) & (k >= F.lit(rules.min_separator_share) * n),
        )
        navigation = (line.rlike(SEPARATOR) & separated) | (few & open_end & F.ltrim(line).rlike(MENU))
        boilerplate = (n <= rules.max_boiler_words) & line.rlike(BOILER)
        return (n > 0) & (punctuation | navigation | boilerplate)

    return let(F.size(words(line)), broken)


def clean_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Add the base counts, ``base_failed``, ``clean_text``, ``clean_share`` and ``kept`` to the rows of ``df``.

    Lines that fail a rule are removed; blank lines stay. ``clean_share`` is the share of the non-blank
    lines' characters that is left. A document is kept if the base rules hold (ten words or more, at most a
    fifth of them in repeated windows) and at least ``min_kept_share`` is left.

    No row leaves its task: nothing shuffles. Texts of any length are read whole, in memory linear in them. Null and empty texts have zero counts, share 0 and are not
    kept; an empty table gives an empty table; rows that repeat are judged alike; columns of ``df`` whose
    names clash with added ones are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("__words", words(F.col(text_col)))
    out = out.withColumns(base_counts(F.col(text_col)) | {"n_repeat_words": repeated_words(F.col("__words"))})
    out = out.drop("__words")
    out = out.withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )
    out = out.withColumn("clean_text", F.array_join(F.filter(F.split(text, "\n"), lambda x: ~line_fails(x, rules)), "\n"))
    left = F.length(F.regexp_replace("clean_text", "[\\x20\\x09-\\x0D]+", ""))
    left = F.when(F.length("clean_text") == F.length(text), F.col("word_chars")).otherwise(left)
    out = out.withColumn("clean_share", F.when(F.col("word_chars") > 0, left / F.col("word_chars")).otherwise(0.0))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("clean_share") >= rules.min_kept_share))


REPORT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def quality_report(docs: DataFrame) -> DataFrame:
    return clean_lines(docs.select("doc_id", "text")).select(*REPORT)


def keep_clean(docs: DataFrame) -> DataFrame:
    """Documents that pass, with failed lines removed from ``text`` and ``n_chars`` (if present) counted anew.

    Other columns of ``docs`` come out as they were, whatever their names.
    """
    # The id that each row gets is no part of the rule: it only keeps the filter above the projection, where
    # the optimizer would otherwise evaluate all rules once more.
    own = docs.select(*[F.col(f"`{c}`").alias(f"__doc_{c}") for c in docs.columns])
    out = clean_lines(own, "__doc_doc_id", "__doc_text").withColumn("__row", F.monotonically_increasing_id()).where("kept AND __row >= 0")
    anew = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return out.select(*[anew.get(c, F.col(f"`__doc_{c}`")).alias(c) for c in docs.columns])


#: The same rules for RE2, whose escapes differ.
_SQL_CLOSED = "[.!?:;,\\x{2026}\\x{3002}\\x{FF01}\\x{FF1F}\\x{061F}\\x{0964}][\"''\\x{201D}\\x{2019}\\x{00BB})\\]]*$"
_SQL_SEPARATOR = "( [|\\x{00BB}\\x{203A}\\x{2022}\\x{00B7}>/] )"
_SQL_MENU, _SQL_BOILER = MENU.replace("'", "''"), BOILER.replace("'", "''").replace("\\u00A9", "\\x{00A9}")

ORACLE = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         row_number() OVER () AS rid
  FROM documents
), win AS (
  SELECT rid, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid
), lines AS (
  SELECT rid, l, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS n,
         NOT regexp_matches(rtrim(l, ' '), '{_SQL_CLOSED}') AS open_end,
         length(l) - length(regexp_replace(l, '[#*$%&|<>{{}}~^\\\\_=!]', '', 'g')) AS sym,
         len(regexp_extract_all(l, '{_SQL_SEPARATOR}')) AS seps
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM t)
), good AS (
  SELECT rid, sum(CASE WHEN sym > 0.1 * length(l) OR (open_end AND n <= 3)
      OR (seps >= 2 AND seps >= 0.2 * n)
      OR (open_end AND n <= 8 AND regexp_matches(ltrim(l, ' '), '{_SQL_MENU}'))
      OR (n <= 30 AND regexp_matches(l, '{_SQL_BOILER}'))
    THEN 0 ELSE length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')) END) AS chars,
    count(*) - count(DISTINCT l) AS dup
  FROM lines WHERE n > 0 GROUP BY rid
), c AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(good.dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         coalesce(good.chars, 0) AS chars
  FROM t LEFT JOIN cov USING (rid) LEFT JOIN good USING (rid)
), b AS (
  SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, chars,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars > 0 AND chars >= 0.5 * word_chars AS kept
FROM b
"""
