"""The rule dimension: identifier, severity and category of every finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.session import literal_frame

# Rule identifiers by severity.  Identifiers are category + three digits.
ERROR_RULES = """
PKG001 PKG006 PKG007 PKG008 PKG009 PKG010 PKG012 XML001
ODF001 ODF002 ODF003 ODF004 ODF005 ODF006 ODF007 ODF011 ODF012
META001 META002 HEADING001 HEADING002 HEADING003
REVISION001 REVISION002 REVISION003 GRAPHIC001 TABLE002
REF001 REF002 REF003 NOTE002 NOTE003 NOTE004 STYLE003 SHEET001
PAGE001 PAGE002 PAGE004 LINK003 MATH001 MATH002 MATH003
CHART001 CHART002 CHART004 CHART005 IMAGE002 IMAGE003 IMAGE004
DATABASE001 DATABASE002 DATABASE003
PDF001 PDF002 PDF003 PDF004 PDF005 PDF007 PDF008 PDF010 PDF011 PDF012 PDF013 PDF014 PDF015
PDF019 PDF020 PDF021 PDF024 PDF025 PDFUA001
FIDELITY001 FIDELITY002 FIDELITY003 FIDELITY004 FIDELITY005 FIDELITY007 FIDELITY008
LIST001 LIST002 LIST003 LIST004 LIST005 LIST006
"""
WARNING_RULES = """
PKG002 PKG003 PKG004 PKG005 PKG011 ODF008 ODF009 SCHEMA001
NATIVE001 NATIVE002 NATIVE003 META003 META004 HEADING004 NOTE001
REVISION004 REVISION005 REVISION006 ORDER001 ORDER002 ORDER003 STYLE001
TABLE001 TABLE003 TABLE004 TABLE005 LANG001 LANG002 REF004 LINK001 LINK002
SHEET002 SHEET003 PAGE003 PAGE005 GRAPHIC002 GRAPHIC003 GRAPHIC004 MATH004
CHART003 CHART006 CHART007 CHART008 CHART009 CHART010 CHART011 IMAGE001 IMAGE005
DATABASE004 DATABASE005 DATABASE006 DATABASE007 DATABASE008 DATABASE009 DATABASE010
PDF006 PDF016 PDF017 PDF018 PDF022 PDF023 LIST007 LIST008 LIST009
"""
INFO_RULES = """
ODF010 SCHEMA002 HEADING005 STYLE002 DATABASE011 DATABASE012 PDF009 FIDELITY006
"""

# Findings that end any further audit of their document.
BLOCKING = ["PKG001", "PKG008", "PKG009", "PKG010", "PKG012", "XML001", "ODF006", "ODF011"]

# The decision kinds and the rules an answer of that kind can resolve.
DECISION_RULES = {
    "document.odf_version": ["ODF001", "ODF003", "ODF004"],
    "document.metadata": ["META001", "META002", "META003", "CHART003", "CHART004"],
    "graphic.alternative": ["GRAPHIC001", "GRAPHIC002"],
    "link.description": ["LINK003"],
    "page.metadata": ["PAGE003"],
    "page.navigation": ["PAGE004", "PAGE005"],
    "database.description": ["DATABASE009"],
    "heading.level": ["HEADING001", "HEADING002", "HEADING003"],
    "table.headers": ["TABLE003"],
    "language.target": ["LANG001"],
    "sheet.name": ["SHEET001", "SHEET002"],
    "formula.alternative": ["MATH003"],
    "text.linkify_addresses": ["LINK001"],
    "text.remove_spacers": ["STYLE002"],
    "text.spacing": [],
}

SEVERITY = {
    **{rule: "error" for rule in ERROR_RULES.split()},
    **{rule: "warning" for rule in WARNING_RULES.split()},
    **{rule: "info" for rule in INFO_RULES.split()},
}


def category_of(rule: Column) -> Column:
    """The lower-case prefix of a rule identifier."""
    return F.lower(F.regexp_replace(rule, "[0-9]+$", ""))


def rules(spark: SparkSession) -> DataFrame:
    """All rules as a broadcast dimension (fixed size)."""
    frame = spark.createDataFrame(sorted(SEVERITY.items()), "rule_id string, severity string")
    return F.broadcast(frame.withColumn("category", category_of(F.col("rule_id"))))


def decision_rules(spark: SparkSession) -> DataFrame:
    """(decision kind, rule it resolves)."""
    rows = [(kind, rule) for kind, found in DECISION_RULES.items() for rule in found]
    return literal_frame(spark, rows, "kind_id string, rule_id string")
