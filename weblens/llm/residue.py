"""Records that are template residue, filler, error or wall pages.

Two kinds of evidence:

* residue anywhere in the text outside code samples and quotations: unfilled
  placeholders, literals left where a value should stand, filler text;
* a message that fills a line of its own (error, access, session, demand for
  scripts) in a record that has no article: the normalised lines of every host
  are counted, lines in at least `least` documents of the host are taken off,
  and what is left beside the messages, each line once, has at most
  `most_article` characters.

Plan: the patterns are tested in the JVM while the table is read; only records
with a message line meet the line counts, which are a distinct and a count on
hashes, combined before the shuffle. The repeated lines are joined salted.

Defined results: NULL, empty and very short content is no case; the status is
not used; repeated rows count once; rows without a site have no repeated lines;
an empty table gives an empty one; other columns are ignored; code fences that
are never closed reach to the end of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import lines, normal_line, repeated_lines, join_few, site

#: Code and quotations, which may show template syntax or messages without being residue.
_QUOTED = (
    r"(?s:```.*?(?:```|\z))|(?s:~~~.*?(?:~~~|\z))|``[^\n]+?``|`[^`\n]*`|(?m:^[ \t]*>[^\n]*$)"
    r"|“[^“”\n]*+”|„[^“”\n]*+[“”]|«[^«»\n]*+»|‹[^‹›\n]*+›|\"[^\"\n]*+\"|‘[^‘’\n]*+’"
)
#: Placeholders, left literals and filler.
RESIDUE = [
    r"\{\{[^{}\n]{0,80}\}\}", r"\{%[^%\n]{0,80}%\}", r"<%[^%\n]{0,80}%>", r"[$#]\{[^{}\n]{0,60}\}", r"\[\[[^\[\]\n]{1,60}\]\]",
    r"@@\w{1,40}@@", r"\*\|\w{1,40}\|\*", r"\b__[A-Za-z]\w{0,40}?__\b", r"%[A-Za-z]\w{1,40}%", r"#[A-Za-z]\w{1,40}#", r"\{[A-Za-z_][\w.]{0,40}\}",
    r"\[(?i:insert|enter|your|add)\b[^\[\]\n]{1,60}\]", r"\[\w{1,40}_(?i:PLACEHOLDER)\]", r"<(?i:your|insert|enter)\b[^<>\n]{1,40}>", r"\bTODO\b", r"\bFIXME\b", r"\bTKTK\b",
    r"\[object Object\]", r"\bundefined\b", r"\bNaN\b", r"\bnull(?: null)+\b", r"\bXX[.:/-]XX\b",
    r"(?i:\blorem\s+ipsum\b)", r"(?i:\b(?:consectetur|adipiscing|eiusmod|incididunt|ullamco|excepteur|cupidatat|proident|occaecat)\b[^\n]{0,80}\b(?:lorem|ipsum|dolor|amet|tempor|labore|veniam|nostrud|nisi|irure|velit|cillum|pariatur|sint|mollit)\b)",
    r"(?i:\b(?:your|sample|placeholder|dummy)\s+(?:text|headline|title|content|name|caption)\s+(?:goes\s+)?here\b)", r"(?i:\bhier\s+steht\s+(?:ihr|der)\s+text\b)", r"(?i:\b(?:judul|isi|teks)\s+\w+\s+di\s+sini\b)",
    r"(?i:\b(?:su|tu|votre|seu|tw[oóÓ]j)\s+(?:texto|texte|tekst)\s+(?:aqu[iíÍ]|ici|tutaj)(?![\p{L}\p{N}_]))", r"(?iu:(?<![\p{L}\p{N}_])ваш\s+текст\s+здесь(?![\p{L}\p{N}_]))",
]
#: Messages that stand in place of an article; each must fill a line.
MESSAGES = [
    r"(?:error\s*)?(?:40[0-9]|41[0-9]|429|50[0-9])(?:\s*[-:–|]?\s*(?:error|not found|bad gateway|forbidden|gateway time-?out|service unavailable|internal server error|unauthorized|too many requests|bad request|gone))?\.?",
    r"(?:page |file )?not found\.?", r"internal server error\.?", r"bad gateway\.?", r"(?:the )?page you are looking for [^\n]{0,80}", r"this page (?:could not be found|isn.t available|is not available|does not exist)\.?",
    r"(?:this )?service (?:is )?(?:temporarily )?unavailable[^\n]{0,60}", r"oops!?[^\n]{0,80}", r"something went wrong[^\n]{0,60}", r"traceback \(most recent call last\):", r"(?:warning|fatal error|parse error|notice): [^\n]{0,160} on line \d+",
    r"access (?:to this (?:page|resource) (?:is|has been) )?denied\.?", r"forbidden\.?", r"you do(?: not|n.t) have permission [^\n]{0,120}", r"too many requests\.?", r"your (?:ip )?address (?:was|has been|is) (?:rate limited|blocked|banned)[^\n]{0,80}",
    r"(?:your |the )?session (?:has |is )?(?:expired|timed out)[^\n]{0,40}", r"(?:please )?log in (?:again )?to (?:read on|continue|view)[^\n]{0,60}", r"(?:please )?(?:sign|log) in to continue[^\n]{0,40}", r"this (?:account|site|website) (?:has been|is) suspended\.?", r"contact your hosting provider\.?",
    r"just a moment\.{0,3}", r"checking (?:that|if|your) [^\n]{0,120}", r"verify (?:that )?you are (?:a )?human[^\n]{0,80}", r"(?:please )?(?:enable|turn on|activate) (?:javascript|scripts|cookies)(?: and (?:cookies|javascript))?(?: (?:in your browser|to (?:continue|view|use|run|proceed)))[^\n]{0,60}",
    r"you need to (?:enable|turn on) (?:javascript|scripts)[^\n]{0,80}", r"(?:this (?:page|site|app) (?:requires|needs)|javascript is (?:required|disabled))[^\n]{0,80}",
    r"seite nicht gefunden[^\n]{0,40}", r"zugriff verweigert\.?", r"(?:bitte )?(?:aktivieren sie javascript|javascript aktivieren)[^\n]{0,80}", r"interner serverfehler\.?", r"ihre sitzung ist abgelaufen[^\n]{0,40}",
    r"halaman tidak ditemukan\.?", r"maaf, (?:tautan|halaman) [^\n]{0,80}", r"aktifkan javascript [^\n]{0,80}", r"akses ditolak\.?", r"sesi anda telah (?:berakhir|habis)[^\n]{0,40}",
    r"(?:cette page|ce site) nécessite [^\n]{0,80}", r"(?:veuillez )?active[rz] (?:le )?javascript[^\n]{0,80}", r"page (?:introuvable|non trouvée)[^\n]{0,40}", r"accès (?:refusé|interdit)\.?",
    r"página no encontrada[^\n]{0,40}", r"acceso denegado\.?", r"(?:por favor,? )?active javascript[^\n]{0,80}", r"página não encontrada[^\n]{0,40}", r"acesso negado\.?", r"ative o javascript[^\n]{0,80}",
    r"страница не найдена[^\n]{0,40}", r"доступ (?:запрещ[её]н|ограничен)\.?", r"включите javascript[^\n]{0,80}", r"(?:strony nie znaleziono|nie znaleziono strony)[^\n]{0,40}", r"odmowa dostępu\.?", r"włącz (?:obsługę )?javascript[^\n]{0,80}",
]
_MESSAGE_LINE = "(?iu)^\\s*(?:" + "|".join(MESSAGES) + ")\\s*$"


def unquoted(content: Column) -> Column:
    return F.regexp_replace(content, _QUOTED, " ")


#: RESIDUE is tested only where one of its signs occurs: each pattern has one here that it cannot match without. Patterns led by a symbol share SYMBOLS, which fails on most characters at once.
SYMBOLS = r"(?=[{<$#\[@*_%])(?:\{\{|\{%|<%|[$#]\{|\[\[|@@|\*\||__[A-Za-z]|%[A-Za-z]\w{1,40}%|#[A-Za-z]\w{1,40}#|\{[A-Za-z_]|\[(?i:insert|enter|your|add)\b|\[\w{1,40}_(?i:PLACEHOLDER)\]|<(?i:your|insert|enter)\b|\[object)"
#: Parts of the patterns that tell capitals from small letters.
SIGNS = ["TODO", "FIXME", "TKTK", "undefined", "NaN", "null null", "XX"]
#: Single words of the patterns that do not, looked for in the lower-cased text; the words before "here" need a pattern, as "here" is in too many texts.
LOWER_SIGNS = ["lorem", "consectetur", "adipiscing", "eiusmod", "incididunt", "ullamco", "excepteur", "cupidatat", "proident", "occaecat", "steht", "sini", "texto", "texte", "tekst", "текст"]
HERE = r"(?=[thcng])(?:text|headline|title|content|name|caption|goes)\s+here"


def _signs(content: Column) -> Column:
    def lower_signs(text: Column) -> Column:
        some = text.contains("here") & text.rlike(HERE)
        for sign in LOWER_SIGNS:
            some = some | text.contains(sign)
        return some

    some = content.rlike(SYMBOLS)
    for sign in SIGNS:
        some = some | content.contains(sign)
    return some | F.exists(F.array(F.lower(content)), lower_signs)  # lower-cased once


def has_residue(content: Column) -> Column:
    """Whether text outside code and quotations has a placeholder, a left literal or filler. Cheap signs are tested first, then the plain text, then the text without code and quotations."""
    any_of = "|".join(RESIDUE)
    return _signs(content) & content.rlike(any_of) & unquoted(content).rlike(any_of)


def message_records(df: DataFrame, key: str, url: str, content: str, least: int = 5, most_article: int = 600) -> DataFrame:
    """(key): records that consist of messages apart from the lines their site repeats."""
    own = df.select(F.col(key), F.col(url), F.col(content))
    counted = lines(own, key, url, content).select(key, F.xxhash64("site", normal_line(F.col("line"))).alias("h"))
    often = repeated_lines(counted, key, least, ["h"]).select("h", F.lit(True).alias("_often"))
    suspects = own.where(F.exists(F.split(content, "\n"), lambda x: x.rlike(_MESSAGE_LINE)))
    each = suspects.select(key, site(F.col(url)).alias("site"), F.explode(F.array_distinct(F.split(content, "\n"))).alias("line")).withColumn("_norm", normal_line(F.col("line")))
    each = each.withColumns({"h": F.xxhash64("site", "_norm"), "_message": F.col("line").rlike(_MESSAGE_LINE)}).select(key, "h", "_message", F.length("_norm").alias("_n")).distinct()
    left = join_few(each, often, ["h"], "left", key)
    rest = F.when(F.col("_message") | F.col("_often").isNotNull(), 0).otherwise(F.col("_n"))
    return left.groupBy(key).agg(F.sum(rest).alias("_rest")).where(F.col("_rest") <= most_article).select(key)


def residue_records(df: DataFrame, key: str, url: str, content: str, least: int = 5, most_article: int = 600) -> DataFrame:
    """(key): distinct keys of the records to exclude."""
    residual = df.where(has_residue(F.col(content))).select(key)
    return residual.unionByName(message_records(df, key, url, content, least, most_article)).distinct()
