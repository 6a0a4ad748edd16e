"""What blanks mean, by form: zero, unticked, or missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import FALSE_WORDS, TRUE_WORDS, blank, fold, kinds, missing, need, quoted, trim
from ..plans.dictionary import BlankRule, Dictionary

AUDIT = "field string, blank_meaning string, field_present boolean, applicable_rows long, applicable_blanks long, values_normalized long, out_of_scope_blanks long, unrecognized_count long, unrecognized_values string"


@dataclass(frozen=True)
class Normalized:
    """``df`` after the rules, and ``audit()``: one row a rule, from one pass over the input."""

    df: DataFrame
    source: DataFrame
    rules: tuple[BlankRule, ...]
    form: str

    def audit(self) -> DataFrame:
        kind = kinds(self.source)
        parts: list[Column] = []
        for r in self.rules:
            here = r.field in kind
            on = applies(r, self.form)
            empty = blank(quoted(r.field), kind[r.field]) if here else F.lit(False)
            odd = on & ~empty & ~fold(quoted(r.field)).isin(*TRUE_WORDS, *FALSE_WORDS) if here and r.blank_meaning == "implicit_false" else F.lit(False)

            def n(c: Column) -> Column:
                return F.coalesce(F.sum(c.cast("long")), F.lit(0))

            words = F.array_join(F.sort_array(F.collect_set(F.when(odd, trim(quoted(r.field))))), "|") if here else F.lit("")
            parts.append(F.struct(
                F.lit(r.field).alias("field"), F.lit(r.blank_meaning).alias("blank_meaning"), F.lit(here).alias("field_present"),
                n(on).alias("applicable_rows"), n(empty & on).alias("applicable_blanks"),
                (n(empty & on) if r.blank_meaning != "literal_missing" else F.lit(0).cast("long")).alias("values_normalized"),
                n(empty & ~on).alias("out_of_scope_blanks"), n(odd).alias("unrecognized_count"), F.nullif(words, F.lit("")).alias("unrecognized_values"),
            ))
        one = self.source.agg(F.array(*parts).alias("rules"))
        out = one.select(F.explode("rules").alias("r")).select("r.*")
        return out.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in AUDIT.split(", ")])


def applies(rule: BlankRule, form: str) -> Column:
    if "*" in rule.forms:
        return F.lit(True)
    return F.coalesce(fold(quoted(form)).isin(*[f.upper() for f in rule.forms]), F.lit(False))


def normalize(df: DataFrame, rules: list[BlankRule], form: str = "RETURN_TYPE", strict: bool = False) -> Normalized:
    """Apply blank rules in one projection.

    ``implicit_zero``: blanks on a form that has the field become 0 (text "0" in a
    text column). ``implicit_false``: the column becomes boolean; blanks are false,
    words outside the vocabulary null, and so is everything on forms without the
    field. ``literal_missing``: nothing changes. An absent field is an error only if ``strict``.
    """
    need(df, form)
    kind = kinds(df)
    new: dict[str, Column] = {}
    for r in rules:
        if r.field not in kind:
            if strict:
                raise ValueError(f"field not found: {r.field}")
            continue
        c, k, on = quoted(r.field), kind[r.field], applies(r, form)
        if r.blank_meaning == "implicit_zero":
            new[r.field] = F.when(on & blank(c, k), F.lit(0).cast(k)).otherwise(c)
        elif r.blank_meaning == "implicit_false":
            word = fold(c)
            new[r.field] = F.when(on & blank(c, k), F.lit(False)).when(on & word.isin(*TRUE_WORDS), F.lit(True)).when(on & word.isin(*FALSE_WORDS), F.lit(False))
    out = df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])
    return Normalized(out, df, tuple(rules), form)


@dataclass(frozen=True)
class PanelNormalized:
    df: DataFrame
    source: DataFrame
    fields: str
    financial_fields: int
    zeroed: Column
    all_missing: Column
    ez: Column
    pf: Column

    def audit(self) -> dict:
        def n(c: Column) -> Column:
            return F.coalesce(F.sum(c.cast("long")), F.lit(0))

        r = self.source.agg(n(self.zeroed).alias("values_zeroed"), n(self.all_missing).alias("all_missing_rows"), n(self.ez).alias("ez_rows"), n(self.pf).alias("pf_rows")).first()
        return {"fields": self.fields, "financial_fields": self.financial_fields, **r.asDict()}


def panel_normalize(df: DataFrame, fields: str = "core", form: str = "RETURN_TYPE", dictionary: Dictionary | None = None) -> PanelNormalized:
    """Blank money fields become 0 where the row's form has the field and the row has any money value at all.

    Without a form column, a row with a Part I but no Part VIII revenue is a 990EZ,
    and a table of 990PF fields alone is a 990PF; a row without a form is a full 990.
    """
    d = dictionary or Dictionary()
    kind = kinds(df)

    def group(scope, of: str = "990") -> list[str]:
        return [c for c in d.financial(fields, scope, of) if c in kind]

    shared, full, ezs, pfs = group(("PZ", "HD", "SG")), group("PC"), group("EZ"), group("PF", "990PF")
    present = list(dict.fromkeys([*shared, *full, *ezs, *pfs]))
    if form in kind:
        word = F.coalesce(fold(quoted(form)), F.lit(""))
        pf, ez = word == "990PF", word == "990EZ"
    else:
        pf = F.lit(bool(pfs) and not (shared or full or ezs))
        one, eight = "F9_01_REV_TOT_CY", "F9_08_REV_TOT_TOT"
        ez = ~missing(quoted(one), kind[one]) & missing(quoted(eight), kind[eight]) if one in kind and eight in kind else F.lit(False)
        ez = ez & ~pf
    nothing = F.lit(bool(present))
    for c in present:
        nothing = nothing & missing(quoted(c), kind[c])
    new: dict[str, Column] = {}
    zeroed = F.lit(0)
    for names, on in ((shared, ~pf), (full, ~ez & ~pf), (ezs, ez), (pfs, pf)):
        for c in names:
            hit = blank(quoted(c), kind[c]) & on & ~nothing
            new[c] = F.when(hit, F.lit(0).cast(kind[c])).otherwise(quoted(c))
            zeroed = zeroed + hit.cast("int")
    out = df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])
    return PanelNormalized(out, df, fields, len(present), zeroed, nothing, ez, pf)
