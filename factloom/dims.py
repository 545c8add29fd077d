"""Dimension tables: small, fixed, broadcast wherever they are joined."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------
TIER_PRIOR = {"A": 1.0, "B": 0.75, "C": 0.45, "D": 0.25, "E": 0.15}

#: key | section | kind | unit | tolerance | range | variant | weight | expected in | synonyms | words for queries
_CORE = """
weight_g | core | number | g | 0.03 | 1..500000 | no | 1.0 | retail,datasheet | weight; вага; вес; gewicht; masa; waga; net weight; product weight | en=weight; uk=вага; de=Gewicht
length_mm | core | number | mm | 0.03 | 1..20000 | no | 1.0 | retail,datasheet | length; довжина; länge; długość |
width_mm | core | number | mm | 0.03 | 1..20000 | no | 1.0 | retail,datasheet | width; ширина; breite; szerokość |
height_mm | core | number | mm | 0.03 | 1..20000 | no | 1.0 | retail,datasheet | height; висота; höhe; wysokość |
color | core | string | | 0 | | yes | 0.6 | retail,datasheet | color; colour; колір; цвет; farbe; kolor |
warranty_months | core | number | months | 0 | 0..240 | no | 0.7 | retail | warranty; гарантія; гарантия; garantie; gwarancja | en=warranty; uk=гарантія; de=Garantie
country_of_origin | core | string | | 0 | | no | 0.4 | retail,datasheet | country of origin; made in; країна виробник; страна производитель; herstellungsland |
in_the_box | core | list | | 0 | | yes | 0.5 | retail,datasheet | in the box; package contents; комплектація; комплектация; lieferumfang; scope of delivery |
"""
_POWER_TOOLS = """
voltage_v | attributes | number | V | 0 | 1..1000 | no | 1.0 | retail,datasheet | voltage; battery voltage; напруга; напряжение; spannung; akkuspannung; napięcie |
max_torque_hard_nm | attributes | number | Nm | 0 | 0.1..5000 | no | 1.0 | retail,datasheet | max torque hard; max. torque (hard); torque hard; max torque; maximum torque; max. torque; hard torque; крутний момент жорсткий; крутящий момент жесткий; drehmoment hart; max. drehmoment | en=torque; uk=крутний момент; de=Drehmoment
max_torque_soft_nm | attributes | number | Nm | 0 | 0.1..5000 | no | 0.7 | retail,datasheet | max torque soft; max. torque (soft); torque soft; soft torque; крутний момент м'який; drehmoment weich |
no_load_speed_rpm | attributes | number | rpm | 0.02 | 1..100000 | no | 0.8 | retail,datasheet | no-load speed; no load speed; rated speed; швидкість холостого ходу; число оборотов; leerlaufdrehzahl; obroty | en=no-load speed; uk=обороти; de=Leerlaufdrehzahl
chuck_capacity_mm | attributes | string | | 0 | | no | 0.6 | retail,datasheet | chuck capacity; chuck range; діаметр патрона; патрон; bohrfutterspannbereich |
chuck_type | attributes | string | | 0 | | no | 0.5 | retail,datasheet | chuck type; chuck; тип патрона; bohrfutter |
battery_capacity_ah | attributes | number | Ah | 0 | 0.1..100 | yes | 0.8 | retail,datasheet | battery capacity; ємність акумулятора; емкость аккумулятора; akkukapazität |
motor_type | attributes | enum | | 0 | | no | 0.6 | retail,datasheet | motor type; motor; тип двигуна; тип двигателя; motortyp |
battery_included | attributes | bool | | 0 | | yes | 0.5 | retail,datasheet | battery included; batteries included; акумулятор в комплекті; akku im lieferumfang |
"""
_SMARTPHONES = """
display_in | attributes | number | in | 0.02 | 2..15 | no | 1.0 | retail,datasheet | display size; screen size; діагональ; диагональ; displaygröße |
storage_gb | attributes | number | GB | 0 | 1..4096 | yes | 1.0 | retail,datasheet | storage; internal storage; вбудована пам'ять; встроенная память; speicher |
ram_gb | attributes | number | GB | 0 | 0.5..64 | no | 0.9 | retail,datasheet | ram; memory; оперативна пам'ять; оперативная память; arbeitsspeicher |
battery_mah | attributes | number | mAh | 0.02 | 500..30000 | no | 0.9 | retail,datasheet | battery; battery capacity; акумулятор; аккумулятор; akku |
chipset | attributes | string | | 0 | | no | 0.9 | retail,datasheet | chipset; processor; soc; процесор; процессор; prozessor |
"""
CATEGORY_KEYWORDS = {
    "generic": [],
    "tools/power_tools": ["drill", "driver", "screwdriver", "шуруповерт", "шуруповёрт", "дриль", "дрель", "akkuschrauber", "bohrschrauber", "grinder", "болгарка", "gsr", "gsb", "gdr", "dhp", "dga", "dtd", "impact"],
    "electronics/smartphones": ["iphone", "galaxy", "smartphone", "смартфон", "pixel", "xiaomi", "redmi", "телефон"],
}
#: brand: aliases, languages
BRANDS = {
    "bosch": (["bosch", "bosch professional"], ["en", "de", "uk"]), "makita": (["makita"], ["en", "ja", "uk"]), "dewalt": (["dewalt", "de walt"], ["en", "uk"]),
    "apple": (["apple", "iphone"], ["en"]), "samsung": (["samsung", "galaxy"], ["en", "ko"]), "xiaomi": (["xiaomi", "redmi", "poco"], ["en", "zh"]),
    "fluke": (["fluke"], ["en"]), "siemens": (["siemens"], ["en", "de"]), "skf": (["skf"], ["en", "de"]),
}
#: canonical unit: factor: spellings
_UNITS = """
g: 1: g gram grams г гр
g: 1000: kg кг kilogram
g: 453.592: lb lbs
g: 28.3495: oz
mm: 1: mm мм
mm: 10: cm см
mm: 1000: m м
in: 1: in inch inches " ″ дюйм
V: 1: v в volt volts
Nm: 1: nm н·м нм n·m n.m
rpm: 1: rpm об/хв об/мин min-1 min⁻¹ /min u/min
Ah: 1: ah а·г
mAh: 1: mah ма·г мач
W: 1: w вт
W: 1000: kw
GB: 1: gb гб
GB: 1024: tb тб
GB: 0.0009765625: mb
months: 1: month months міс місяців місяці мес monate mo
months: 12: year years yr рік роки років год года лет jahre jahr lata
"""
CROSS = {("in", "mm"): 25.4, ("mm", "in"): 1 / 25.4, ("mAh", "Ah"): 0.001, ("Ah", "mAh"): 1000.0}
TRUE_WORDS = ["yes", "так", "да", "ja", "tak", "true", "1", "included", "в комплекті", "в комплекте"]
FALSE_WORDS = ["no", "ні", "нет", "nein", "nie", "false", "0", "not included", "without", "без", "solo", "body only", "bare tool"]
ENUMS = {"motor_type": {"brushless": ["brushless", "безщітковий", "бесщеточный", "bürstenlos", "bl"], "brushed": ["brushed", "щітковий", "щеточный", "bürsten"]}}
CONTEXTS = [
    ("net_without_battery", r"excl\.?\s*batt|without batt|ohne akku|без акум|без батар|net"),
    ("with_battery", r"incl\.?\s*batt|with batt|mit akku|з акум|с акум|gross"),
    ("package", r"package|packag|упаков|verpack"),
]
DOMAIN_OWNERS = {"rozetka.com.ua": "rozetka", "prom.ua": "rozetka", "bigl.ua": "rozetka", "allegro.pl": "allegro", "ceneo.pl": "allegro", "shop-a.example": "groupA", "shop-c.example": "groupA"}
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "tag"]
COLORS = ["black", "white", "blue", "red", "green", "gray", "grey", "silver", "gold", "чорний", "білий", "синій", "сірий", "черный", "белый", "серый", "schwarz", "weiß", "blau"]
KITS = ["solo", "body only", "bare tool", "без акб", "без акумулятора", "l-boxx", "kit", "набір", "набор"]
STORAGE_SIZES = ["64", "128", "256", "512", "1024", "2048"]
SERIES_WORDS = ["professional"]
#: Cyrillic letters and the Latin ones that look like them.
HOMOGLYPHS = ("авекмнорстхуАВЕКМНОРСТХУ", "abekmhopctxyABEKMHOPCTXY")
#: mode: rounds, pages, seconds
BUDGETS = {"fast": (1, 20, 8.0), "standard": (3, 60, 60.0), "deep": (8, 200, 300.0)}
GAIN_EPS = 0.05
# ---- end of fixed values ------------------------------------------------------------------------------------

UNITS = {spelling: (canon, float(factor)) for canon, factor, names in (line.split(": ", 2) for line in _UNITS.strip().split("\n")) for spelling in names.split()}


def _attributes(lines: str) -> list[dict]:
    out = []
    for line in lines.strip().split("\n"):
        key, section, kind, unit, tolerance, span, variant, weight, expected, synonyms, words = (x.strip() for x in line.split("|"))
        lo, _, hi = span.partition("..")
        out.append({
            "key": key, "section": section, "kind": kind, "unit": unit or None, "tolerance": float(tolerance), "lo": float(lo) if lo else None, "hi": float(hi) if hi else None,
            "variant_specific": variant == "yes", "weight": float(weight), "expected_in": expected.split(","), "synonyms": [s.strip() for s in synonyms.split(";")],
            "words": dict(w.strip().split("=") for w in words.split(";") if w.strip()),
        })
    return out


_OWN = {"generic": "", "tools/power_tools": _POWER_TOOLS, "electronics/smartphones": _SMARTPHONES}
#: category -> its attributes in order, the core ones first
ATTRIBUTES = {c: _attributes(_CORE) + (_attributes(text) if text else []) for c, text in _OWN.items()}


def _rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A literal table, without a Python worker or a job of its own."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def attribute_specs(spark: SparkSession) -> DataFrame:
    """One row for each category and attribute."""
    ddl = "category:string,spec_ord:int,key:string,section:string,kind:string,unit:string,tolerance:double,lo:double,hi:double,variant_specific:boolean,weight:double,expected_in:array<string>,synonyms:array<string>,words:map<string,string>"
    return _rows(spark, [{"category": c, "spec_ord": i} | a for c, own in ATTRIBUTES.items() for i, a in enumerate(own)], ddl)


def synonyms(spark: SparkSession) -> DataFrame:
    """(category, syn_rank, synonym, field): longest first, in the attributes' order."""
    rows = []
    for category, own in ATTRIBUTES.items():
        pairs = [(s.lower(), a["key"]) for a in own for s in [a["key"].replace("_", " "), *a["synonyms"]]]
        rows += [{"category": category, "syn_rank": i, "synonym": s, "field": k} for i, (s, k) in enumerate(sorted(pairs, key=lambda p: -len(p[0])))]
    return _rows(spark, rows, "category:string,syn_rank:int,synonym:string,field:string")
