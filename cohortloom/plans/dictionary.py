"""What is known of each field: scope, type, table, and what a blank in it means."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

from .catalog import form_family
from .identities import IDENTITIES

# The columns that together tell one filing, in every table.
FILING_KEYS = (
    "EIN2", "OBJECTID", "ORG_EIN", "ORG_EXEMPT_TYPE", "ORG_NAME_L1", "ORG_NAME_L2", "RETURN_AMENDED_X", "RETURN_GROUP_X", "RETURN_PARTIAL_X",
    "RETURN_TAXPER_DAYS", "RETURN_TIME_STAMP", "RETURN_TYPE", "TAX_PERIOD_BEGIN_DATE", "TAX_PERIOD_END_DATE", "TAX_YEAR", "URL", "VERSION",
)
#: Types of the key block, which a dictionary entry never overrides; the others are text.
KEY_TYPES = {"RETURN_AMENDED_X": "checkbox", "RETURN_GROUP_X": "checkbox", "RETURN_PARTIAL_X": "checkbox", "RETURN_TAXPER_DAYS": "integer", "TAX_YEAR": "integer",
             "TAX_PERIOD_BEGIN_DATE": "date", "TAX_PERIOD_END_DATE": "date"}
MEANINGS = ("implicit_zero", "implicit_false", "literal_missing")
# Scopes of fields and the forms they are on, and the tables of the primary statements.
SCOPE_FORMS = {"PC": ("990",), "EZ": ("990EZ",), "PZ": ("990", "990EZ"), "PF": ("990PF",), "HD": ("*",), "SG": ("*",)}
FORM_SCOPES = {"both": ("PZ", "HD", "SG"), "990": ("PC", "PZ", "HD", "SG"), "990EZ": ("EZ", "PZ", "HD", "SG"), "all": None, "990PF": None}
CORE_TABLES = {"990": r"F9-P(01|08|09|10|11)-", "990PF": r"PF-P0[1-3]-"}


@dataclass(frozen=True)
class Field:
    name: str
    scope: str
    type: str = "text"
    table: str = ""
    money: bool = False
    description: str = ""
    form: str = "990"

    @property
    def blank_meaning(self) -> str:
        if self.type == "numeric" and self.money:
            return "implicit_zero"
        return "implicit_false" if self.type == "checkbox" else "literal_missing"

    @property
    def forms(self) -> tuple[str, ...]:
        return SCOPE_FORMS[self.scope]


_PREFIX_TABLES = {
    "F9_01_": "F9-P01-T00-SUMMARY", "F9_08_": "F9-P08-T00-REVENUE", "F9_09_": "F9-P09-T00-EXPENSES", "F9_10_": "F9-P10-T00-BALANCE-SHEET",
    "PF_01_": "PF-P01-T00-REVENUE-EXPENSE", "PF_02_": "PF-P02-T00-BALANCE-SHEET", "PF_03_": "PF-P03-T00-NET-ASSET-FUND-BALANCE-CHANGE",
}
# Fields outside the identities whose scope is known.
_OTHERS = (
    Field("F9_01_REV_TOT_CY", "PZ", "numeric", "F9-P01-T00-SUMMARY", True, "total revenue, current year"),
    Field("F9_01_EXP_TOT_CY", "PZ", "numeric", "F9-P01-T00-SUMMARY", True, "total expenses, current year"),
)


@cache
def built_in() -> tuple[Field, ...]:
    """The key block and all variables of the accounting identities."""
    keys = [Field(k, "HD", KEY_TYPES.get(k, "text"), "F9-P00-T00-HEADER") for k in FILING_KEYS]
    money = {}
    for i in IDENTITIES:
        for v in i.variables:
            money.setdefault(v, Field(v, "PF" if i.form == "990PF" else "PC", "numeric", _PREFIX_TABLES[v[:6]], True, form=i.form))
    return (*keys, *_OTHERS, *money.values())


class Dictionary:
    """Fields by name; where both families have one, the 990 entry stands."""

    def __init__(self, fields: Iterable[Field] | None = None):
        self.by_form: dict[str, dict[str, Field]] = {"990": {}, "990PF": {}}
        for f in built_in() if fields is None else fields:
            self.by_form[f.form].setdefault(f.name, f)
            if f.scope in ("HD", "SG"):
                self.by_form["990PF"].setdefault(f.name, f)

    def fields(self, form: str | None = None) -> list[Field]:
        if form:
            return list(self.by_form[form_family(form)].values())
        return list({**self.by_form["990PF"], **self.by_form["990"]}.values())

    def get(self, name: str) -> Field | None:
        return self.by_form["990"].get(name) or self.by_form["990PF"].get(name)

    def type_of(self, name: str) -> str:
        if name in FILING_KEYS:
            return KEY_TYPES.get(name, "text")
        f = self.get(name)
        return f.type if f else "text"

    def in_scope(self, form: str = "both") -> list[str]:
        """Names on a return form: ``both``, ``990``, ``990EZ``, ``all`` or ``990PF``; header and signature always."""
        if form not in FORM_SCOPES:
            raise ValueError(f"form must be one of {', '.join(FORM_SCOPES)}")
        scopes = FORM_SCOPES[form]
        pool = self.fields("990PF" if form == "990PF" else "990")
        return sorted({f.name for f in pool if scopes is None or f.scope in scopes})

    def financial(self, fields: str = "core", scope=None, form: str = "990") -> list[str]:
        """Money fields, of the primary statements (``core``) or ``all``, in the scopes given."""
        if fields not in ("core", "all"):
            raise ValueError("fields must be core or all")
        form = form_family(form)
        scopes = None if scope is None else {scope} if isinstance(scope, str) else set(scope)
        return [f.name for f in self.fields(form) if f.money and (fields == "all" or re.match(CORE_TABLES[form], f.table)) and (scopes is None or f.scope in scopes)]

    def expand_tables(self, names: Iterable[str]) -> list[str]:
        """``P08`` is any table of that part, ``PF01`` one of the 990PF, others are beginnings of names."""
        known = list(dict.fromkeys(f.table for f in self.fields() if f.table))
        out: list[str] = []
        for n in (str(x).strip().upper() for x in names):
            if re.fullmatch(r"P\d\d", n):
                out += [t for t in known if f"-{n}-" in t]
            elif re.fullmatch(r"PF\d\d", n):
                out += [t for t in known if t.startswith(f"PF-P{n[2:]}-")]
            else:
                out += [t for t in known if t.upper().startswith(n)]
        return list(dict.fromkeys(out))

    def select(self, columns: list[str], scope=None, tables=None, keep=None, drop=None) -> list[str]:
        """The ``columns`` that a selection leaves, in their order.

        Header fields and columns outside the dictionary always stay but for ``drop``,
        and header fields come back even then.
        """
        every = {f.name: f for f in self.fields()}
        header = {n for n, f in every.items() if f.scope == "HD"}
        scopes = None if not scope else [scope] if isinstance(scope, str) else list(scope)
        if scopes is None:
            in_scope = set(every)
        elif all(s in FORM_SCOPES for s in scopes):
            in_scope = {n for s in scopes for n in self.in_scope(s)}
        else:
            in_scope = {n for n, f in every.items() if f.scope in {s.upper() for s in scopes}}
        in_tables = set(every) if not tables else {n for n, f in every.items() if f.table in set(self.expand_tables([tables] if isinstance(tables, str) else tables))}
        wanted = header | (in_scope & in_tables) | set(keep or ()) | (set(columns) - set(every))
        wanted = (wanted - set(drop or ())) | header
        return [c for c in columns if c in wanted]


def load_dictionary(path: str, form: str = "990") -> list[Field]:
    """Fields from a CSV file with ``variable_name``, ``variable_scope``, ``data_type_simple``, ``rdb_table``, ``money_field``, ``description``."""
    with open(path, newline="", encoding="utf-8") as f:
        return [
            Field(r["variable_name"], r["variable_scope"], r.get("data_type_simple") or "text", r.get("rdb_table") or "",
                  str(r.get("money_field", "")).upper() in ("TRUE", "T", "1"), r.get("description") or "", form_family(form))
            for r in csv.DictReader(f)
        ]


@dataclass(frozen=True)
class BlankRule:
    """What a blank in ``field`` means on the ``forms`` ("*": any) that have it."""

    field: str
    blank_meaning: str
    forms: tuple[str, ...] = ("*",)
    table: str | None = None
    notes: str | None = None


def concordance(field=None, blank_meaning=None, forms="*", table=None, notes=None, form: str = "990", dictionary: Dictionary | None = None) -> list[BlankRule]:
    """Blank rules: of the dictionary, or of the fields given, one for each; single arguments hold for all.

    ``forms`` is text with ``|`` between forms, or a list of such lists.
    """
    if field is None:
        return [BlankRule(f.name, f.blank_meaning, f.forms, f.table, f.description) for f in (dictionary or Dictionary()).fields(form)]
    names = [field] if isinstance(field, str) else list(field)
    if not names or not all(isinstance(n, str) and n for n in names):
        raise ValueError("a rule's field needs a name")
    if len(set(names)) < len(names):
        raise ValueError("a field has more than one rule")

    def each(value, what: str) -> list:
        got = list(value) if isinstance(value, (list, tuple)) else [value]
        if len(got) not in (1, len(names)):
            raise ValueError(f"{what} must have one value or as many as field")
        return got * len(names) if len(got) == 1 else got

    meanings, tables, remarks = each(blank_meaning, "blank_meaning"), each(table, "table"), each(notes, "notes")
    if bad := sorted({str(m) for m in meanings if m not in MEANINGS}):
        raise ValueError(f"unknown blank_meaning: {', '.join(bad)}")
    parsed = [tuple(dict.fromkeys(str(x).strip() for x in (f.split("|") if isinstance(f, str) else f))) for f in each(forms, "forms")]
    if any(not f or not all(f) for f in parsed):
        raise ValueError("every forms rule needs at least one form")
    return [BlankRule(*r) for r in zip(names, meanings, parsed, tables, remarks)]
