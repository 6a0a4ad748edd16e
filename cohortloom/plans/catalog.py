"""Form families, published tables, and where their files lie."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

FORMS = ("990", "990PF")
PREFIX = {"990": "efile_", "990PF": "efilepf_"}
DEFAULT_VERSION = "v3_1"
EXTENSIONS = {"parquet": ".parquet", "csv": ".CSV"}

# Short names of tables, by form family.
ALIASES = {
    "990": {
        "P00": "F9-P00-T00-HEADER",
        "P01": "F9-P01-T00-SUMMARY",
        "P08": "F9-P08-T00-REVENUE",
        "P09": "F9-P09-T00-EXPENSES",
        "P10": "F9-P10-T00-BALANCE-SHEET",
        "P11": "F9-P11-T00-ASSETS",
        "P12": "F9-P12-T00-FINANCIAL-REPORTING",
        "A01": "SA-P01-T00-PUBLIC-CHARITY-STATUS",
    },
    "990PF": {
        "P00": "F9-P00-T00-HEADER",
        "PF00": "PF-P00-T00-HEADER",
        "PF01": "PF-P01-T00-REVENUE-EXPENSE",
        "PF02": "PF-P02-T00-BALANCE-SHEET",
        "PF03": "PF-P03-T00-NET-ASSET-FUND-BALANCE-CHANGE",
    },
}

# The file stems of each release, in the order of the forms' parts.
TABLES = {
    "990": """
        F9-P00-T00-HEADER
        F9-P00-T01-AFFILIATE-LISTING
        F9-P01-T00-SUMMARY
        F9-P01-T00-SUMMARY-EZ
        F9-P02-T00-SIGNATURE
        F9-P03-T00-MISSION
        F9-P03-T00-PROGRAM-ONE
        F9-P03-T00-PROGRAM-THREE
        F9-P03-T00-PROGRAM-TWO
        F9-P03-T00-PROGRAMS
        F9-P03-T01-PROGRAMS-OTHER
        F9-P03-T02-PROGRAMS-EZ
        F9-P04-T00-REQUIRED-SCHEDULES
        F9-P04-T00-REQUIRED-SCHEDULES-EZ
        F9-P05-T00-OTHER-IRS-FILING
        F9-P06-T00-GOVERNANCE
        F9-P06-T00-GOVERNANCE-EZ
        F9-P07-T00-DIR-TRUST-KEY
        F9-P07-T01-COMPENSATION
        F9-P07-T01-COMPENSATION-HCE-EZ
        F9-P07-T02-CONTRACTORS
        F9-P08-T00-REVENUE
        F9-P08-T01-REVENUE-PROGRAMS
        F9-P08-T02-REVENUE-MISC
        F9-P09-T00-EXPENSES
        F9-P09-T01-EXPENSES-OTHER
        F9-P10-T00-BALANCE-SHEET
        F9-P11-T00-ASSETS
        F9-P12-T00-FINANCIAL-REPORTING
        SA-P00-T00-HEADER
        SA-P01-T00-PUBLIC-CHARITY-STATUS
        SA-P01-T01-PUBLIC-CHARITY-STATUS
        SA-P01-T02-HOSPITAL-NAME-ADDRESS
        SA-P01-T03-AGRI-RESEARCH-UNIV
        SA-P02-T00-SUPPORT_SCHEDULE_170
        SA-P03-T00-SUPPORT_SCHEDULE_509
        SA-P04-T00-SUPPORT-ORGS
        SA-P05-T00-SUPPORT-ORGS
        SA-P06-T99-SUPPLEMENTAL-INFO
        SB-P00-T00-HEADER
        SB-P01-T01-CONTRIBUTORS
        SB-P02-T01-NONCASH-PROPERTY
        SB-P03-T00-EXCLUSIVELY-RELIGIOUS
        SB-P03-T01-EXCLUSIVELY-RELIGIOUS
        SC-P01-T00-LOBBY
        SC-P01-T01-POLITICAL-ORGS-INFO
        SC-P02-T00-LOBBY
        SC-P02-T01-AFFILIATED-GROUP
        SC-P03-T00-LOBBY
        SC-P04-T99-SUPPLEMENTAL-INFO
        SD-P01-T00-ORGS-DONOR-ADVISED-FUNDS-OTH
        SD-P02-T00-CONSERV-EASEMENTS
        SD-P03-T00-ORGS-COLLECT-ART-HIST-TREASURE-OTH
        SD-P04-T00-ESCROW-CUSTODIAL-ARRANGEMENTS
        SD-P05-T00-ENDOWMENT
        SD-P06-T00-LAND-BLDG-EQUIP
        SD-P07-T00-INVESTMENTS-OTH-DERIVATIVES
        SD-P07-T00-INVESTMENTS-OTH-EQUITY
        SD-P07-T00-INVESTMENTS-SECURITIES
        SD-P07-T01-INVESTMENTS-OTH-SECURITIES
        SD-P08-T00-INVESTMENTS-PROG-RLTD
        SD-P08-T01-INVESTMENTS-PROG-RLTD
        SD-P09-T00-OTH-ASSETS
        SD-P09-T01-OTH-ASSETS
        SD-P10-T00-OTH-LIABILITIES
        SD-P10-T01-OTH-LIABILITIES
        SD-P11-T00-RECONCILIATION-REVENUE
        SD-P12-T00-RECONCILIATION-EXPENSES
        SD-P13-T99-SUPPLEMENTAL-INFO
        SD-P99-T00-RECONCILIATION-NETASSETS
        SE-P01-T00-SCHOOLS
        SE-P02-T99-SUPPLEMENTAL-INFO
        SF-P01-T00-FRGN-ACTS
        SF-P01-T01-FRGN-ACTS-BY-REGION
        SF-P02-T00-FRGN-ORG-GRANTS
        SF-P02-T01-FRGN-ORG-GRANTS
        SF-P03-T01-FRGN-INDIV-GRANTS
        SF-P04-T00-FRGN-INTERESTS
        SF-P05-T99-EXPLANATION-TEXT
        SF-P99-T00-FRGN-ORG-GRANTS
        SG-P01-T00-FUNDRAISING-ACTS
        SG-P01-T01-FUNDRAISERS-INFO
        SG-P02-T00-FUNDRAISING-EVENTS
        SG-P03-T00-GAMING
        SG-P04-T99-SUPPLEMENTAL-INFO
        SH-P01-T00-FAP-COMMUNITY-BENEFIT-POLICY
        SH-P02-T00-FAP-COMMUNITY-BENEFIT-POLICY
        SH-P03-T00-FAP-COMMUNITY-BENEFIT-POLICY
        SH-P04-T01-COMPANY-JOINT-VENTURES
        SH-P05-T00-FAP-COMMUNITY-BENEFIT-POLICY
        SH-P05-T01-HOSPITAL-FACILITY
        SH-P05-T02-NON-HOSPITAL-FACILITY
        SH-P05-T03-FACILITY-POLICIES-PRACTICES
        SH-P05-T99-SUPPLEMENTAL-INFO
        SH-P06-T99-SUPPLEMENTAL-INFO
        SH-P99-T01-FAP-COMMUNITY-BENEFIT-POLICY
        SI-P01-T00-GRANTS-INFO
        SI-P02-T00-GRANTS-US-ORGS-GOVTS
        SI-P02-T01-GRANTS-US-ORGS-GOVTS
        SI-P03-T01-GRANTS-US-INDIV
        SI-P04-T99-SUPPLEMENTAL-INFO
        SI-P99-T00-GRANTS-US-ORGS-GOVTS
        SJ-P01-T00-COMPENSATION
        SJ-P02-T01-COMPENSATION-DTK
        SJ-P03-T99-SUPPLEMENTAL-INFO
        SK-P01-T01-BOND-ISSUES
        SK-P02-T01-BOND-PROCEEDS
        SK-P03-T01-BOND-PRIVATE-BIZ-USE
        SK-P04-T01-BOND-ARBITRAGE
        SK-P05-T01-PROCEDURE-CORRECTIVE-ACT
        SK-P06-T99-SUPPLEMENTAL-INFO
        SL-P01-T00-EXCESS-BENEFIT-TRANSAC
        SL-P01-T01-EXCESS-BENEFIT-TRANSAC
        SL-P02-T00-LOANS-INTERESTED-PERS
        SL-P02-T01-LOANS-INTERESTED-PERS
        SL-P03-T01-GRANTS-INTERESTED-PERS
        SL-P04-T01-BIZ-TRANSAC-INTERESTED-PERS
        SL-P05-T99-SUPPLEMENTAL-INFO
        SM-P01-T00-NONCASH-CONTRIBUTIONS
        SM-P01-T01-NONCASH-CONTRIBUTIONS
        SM-P02-T99-SUPPLEMENTAL-INFO
        SN-P01-T00-LIQUIDATION-TERMINATION-DISSOLUTION
        SN-P01-T01-LIQUIDATION-TERMINATION-DISSOLUTION
        SN-P02-T00-DISPOSITION-OF-ASSETS
        SN-P02-T01-DISPOSITION-OF-ASSETS
        SN-P03-T99-SUPPLEMENTAL-INFO
        SN-P99-T00-LIQUIDATION-TERMINATION-DISSOLUTION
        SO-P00-T99-SUPPLEMENTAL-INFO
        SR-P01-T01-ID-DISREGARDED-ENTITIES
        SR-P02-T01-ID-RLTD-TAX-EXEMPED-ORGS
        SR-P03-T01-ID-RLTD-ORGS-TAXABLE-PARTNERSHIP
        SR-P04-T01-ID-RLTD-ORGS-TAXABLE-CORPORATION
        SR-P05-T00-TRANSACTIONS-RLTD-ORGS
        SR-P05-T01-TRANSACTIONS-RLTD-ORGS
        SR-P06-T01-UNRLTD-ORGS-TAXABLE-PARTNERSHIP
        SR-P07-T99-SUPPLEMENTAL-INFO
    """.split(),
    "990PF": """
        F9-P00-T00-HEADER
        F9-P02-T00-SIGNATURE
        SB-P00-T00-HEADER
        SB-P01-T01-CONTRIBUTORS
        SB-P02-T01-NONCASH-PROPERTY
        SB-P03-T00-EXCLUSIVELY-RELIGIOUS
        SB-P03-T01-EXCLUSIVELY-RELIGIOUS
        PF-P00-T00-HEADER
        PF-P01-T00-REVENUE-EXPENSE
        PF-P02-T00-BALANCE-SHEET
        PF-P03-T00-NET-ASSET-FUND-BALANCE-CHANGE
        PF-P04-T00-INVEST-INCOME-TAX-CAPITAL-GAINLOSS
        PF-P04-T01-INVEST-INCOME-TAX-CAPITAL-GAINLOSS
        PF-P05-T00-NET-INVEST-INCOME-TAX-4940E
        PF-P06-T00-INVEST-INCOME-EXCISE-TAX
        PF-P07-T00-ACTIVITIES
        PF-P07-T00-ACTIVITIES-4720
        PF-P08-T00-COMPENSATION-CONTRACTORS
        PF-P08-T00-COMPENSATION-HIGHEST
        PF-P08-T01-COMPENSATION
        PF-P08-T02-COMPENSATION-HIGHEST
        PF-P08-T03-COMPENSATION-CONTRACTORS
        PF-P09-T00-PROG-RELATED-INVESTMENTS
        PF-P09-T01-CHARITABLE-ACTIVITIES
        PF-P09-T02-PROG-RELATED-INVESTMENTS
        PF-P10-T00-MINIMUM-INVESTMENT-RETURN
        PF-P11-T00-DISTRIBUTABLE-AMOUNT
        PF-P12-T00-QUALIFYING-DISTRIBUTIONS
        PF-P13-T00-UNDISTRIBUTED-INCOME
        PF-P14-T00-PRIVATE-OPERATING-FOUNDATIONS
        PF-P15-T00-SUPPLEMENTARY-INFO
        PF-P15-T00-SUPPLEMENTARY-INFO-GRANT-FUTURE
        PF-P15-T00-SUPPLEMENTARY-INFO-GRANT-PAID
        PF-P15-T01-SUPPLEMENTARY-INFO-GRANT-PAID
        PF-P15-T02-SUPPLEMENTARY-INFO-GRANT-FUTURE
        PF-P15-T03-SUPPLEMENTARY-INFO-GRANT-APP
        PF-P16-T00-INCOME-PRODUCING-ACTS
        PF-P16-T01-INCOME-PRODUCING-ACTS
        PF-P16-T02-INCOME-PRODUCING-ACTS
        PF-P16-T03-ACTS-RELATIONSHIP-EXEMPT-PURPOSE
        PF-P17-T00-RELATIONSHIPS
        PF-P17-T00-TRANSFERS-TRANSACTIONS
        PF-P17-T01-TRANSFERS-TRANSACTIONS
        PF-P17-T02-RELATIONSHIPS
        PF-P99-T00-AUXILLIARY
        PF-P99-T01-ACC-FEES
        PF-P99-T03-PROG-INVEST-OTH
        PF-P99-T04-AMORTIZATION
        PF-P99-T06-FUND-BORROWED
        PF-P99-T09-COMP
        PF-P99-T10-COMP-KONTR
        PF-P99-T11-DEPREC
        PF-P99-T12-DISSOLUTION
        PF-P99-T14-COMP-EMPL
        PF-P99-T16-EXP-RESPONSIBILITY
        PF-P99-T19-SALE-NONPUB-SEC
        PF-P99-T20-SALE-OTH-ASSET
        PF-P99-T21-SALE-PUB-SEC
        PF-P99-T22-SUPPLEMENTAL-INFO
        PF-P99-T23-INVEST-CORP-BOND
        PF-P99-T24-INVEST-CORP-STOCK
        PF-P99-T25-INVEST-GOVT-SEC
        PF-P99-T26-INVEST-LAND
        PF-P99-T27-INVEST-OTH
        PF-P99-T28-LAND-ETC
        PF-P99-T29-LEGAL-FEES
        PF-P99-T31-LOAN-OFF
        PF-P99-T32-MTG-NOTE
        PF-P99-T33-ASSET-OTH
        PF-P99-T34-NETASSET-CHANGE
        PF-P99-T35-DECREASE-OTH
        PF-P99-T36-EXP-OTH
        PF-P99-T37-INCOME-OTH
        PF-P99-T38-INCREASE-OTH
        PF-P99-T39-LIAB-OTH
        PF-P99-T40-NOTE-LOAN-OTH-LONG
        PF-P99-T41-NOTE-LOAN-OTH-SHORT
        PF-P99-T42-PROF-FEES-OTH
        PF-P99-T43-OFF-OTH
        PF-P99-T46-SALE-INV
        PF-P99-T48-CONTRIBUTOR
        PF-P99-T49-TAXES
        PF-P99-T51-TRANSFER-FROM-CE
        PF-P99-T52-TRANSFER-TO-CE
    """.split(),
}


def form_family(form: str) -> str:
    """"990" or "990PF" from any spelling; 990EZ filers are in the 990 release."""
    name = re.sub(r"[\s-]", "", form).upper() if isinstance(form, str) else ""
    if name in ("PF", "990PF"):
        return "990PF"
    if name == "990":
        return "990"
    if name == "990EZ":
        raise ValueError("there is no release of 990EZ alone: read form 990 and keep its RETURN_TYPE")
    raise ValueError(f"form must be one of {', '.join(FORMS)}; received {form!r}")


def default_version() -> str:
    """The release that a source takes when none is named."""
    return DEFAULT_VERSION


def cardinality(table: str) -> str:
    """From the T-number: 00 is one row a filing, 99 supplemental text, others many rows."""
    found = re.search(r"-T(\d\d)(-|$)", table)
    if not found:
        return "unknown"
    return {"00": "1x1", "99": "supplemental"}.get(found[1], "1xm")


def file_format(name: str) -> str:
    """"parquet" or "csv"; ``pq`` is parquet too."""
    found = {"parquet": "parquet", "pq": "parquet", "csv": "csv"}.get(str(name).strip().lower())
    if not found:
        raise ValueError(f"format must be parquet or csv; received {name!r}")
    return found


def format_of(path: str) -> str:
    """The format that a file's extension tells, in upper or lower case."""
    return file_format(PurePosixPath(str(path)).suffix[1:] or "csv")


@dataclass(frozen=True)
class DataSource:
    """One release in one form family: ``root`` holds ``<table>-<year>.<extension>`` files."""

    root: str
    version: str | None = None
    format: str = "parquet"
    form: str = "990"
    aliases: dict[str, str] = field(default_factory=dict)

    def path(self, table: str, year: int) -> str:
        return f"{self.root.rstrip('/')}/{self.filename(table, year)}"

    def filename(self, table: str, year: int) -> str:
        return f"{table}-{int(year)}{EXTENSIONS[self.format]}"

    def cache_path(self, folder: str, table: str, year: int) -> str:
        """Where a staged copy lies: by year, the 990PF family in a folder of its own."""
        own = "990PF/" if self.form == "990PF" else ""
        return f"{folder.rstrip('/')}/{own}{int(year)}/{self.filename(table, year)}"


def data_source(root: str | None = None, version: str = DEFAULT_VERSION, format: str = "parquet", aliases: dict[str, str] | None = None,
                form: str = "990", mirror: str | None = None) -> DataSource:
    """A source at ``root``, or at a release's folder under ``mirror`` (then ``version`` counts)."""
    form = form_family(form)
    if aliases is None:
        aliases = ALIASES[form]
    if not isinstance(aliases, dict) or not all(k and isinstance(k, str) for k in aliases):
        raise ValueError("aliases map short names to tables")
    if root is not None:
        if not isinstance(root, str) or not root:
            raise ValueError("root is where the table-years lie: a path, as text")
        return DataSource(root, None, file_format(format), form, dict(aliases))
    name = re.sub(r"^efile(pf)?_", "", str(version).strip().lower())
    if not re.fullmatch(r"v\d+_\d+", name):
        raise ValueError(f'{version!r} is no release: write v, a number, _ and a number')
    if not mirror:
        raise ValueError("give root, or mirror with a version")
    return DataSource(f"{mirror.rstrip('/')}/{PREFIX[form]}{name}/", name, file_format(format), form, dict(aliases))


def with_format(source: DataSource, format: str) -> DataSource:
    return replace(source, format=file_format(format))


@dataclass(frozen=True)
class Resolved:
    request: str
    table: str
    is_alias: bool
    cardinality: str
    known: bool


def resolve_tables(tables: list[str] | str, source: DataSource) -> list[Resolved]:
    """Aliases and literal names to tables. Unknown literals pass; tables of the other family don't."""
    names = [tables] if isinstance(tables, str) else list(tables)
    if not names or not all(isinstance(t, str) and t.strip() for t in names):
        raise ValueError("name at least one table, by alias or in full")
    aliases = {k.upper(): v for k, v in source.aliases.items()}
    out, wrong = [], []
    for request in (t.strip() for t in names):
        table = aliases.get(request.upper(), request.upper())
        is_alias = request.upper() in aliases
        pf = table.startswith("PF-") or (not is_alias and request.upper() in ALIASES["990PF"])
        if (not pf and table not in TABLES["990PF"]) if source.form == "990PF" else pf:
            wrong.append(request)
        out.append(Resolved(request, table, is_alias, cardinality(table), table in TABLES[source.form]))
    if wrong:
        raise ValueError(f"not published in the {source.form} release: {', '.join(dict.fromkeys(wrong))}")
    return out


def table_catalog(spark: SparkSession, kind: str = "all", form: str = "990") -> DataFrame:
    """``table``, ``alias`` (or null) and ``cardinality`` of every published table of a family."""
    if kind not in ("all", "1x1", "1xm", "supplemental"):
        raise ValueError("unknown kind of table: all, 1x1, 1xm and supplemental are known")
    form = form_family(form)
    alias = {v: k for k, v in ALIASES[form].items()}
    rows = [(t, alias.get(t), cardinality(t)) for t in TABLES[form] if kind in ("all", cardinality(t))]
    return spark.createDataFrame(rows, "table string, alias string, cardinality string")
