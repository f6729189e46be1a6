"""Problem 5: quantities recorded in different units, converted to the common unit of their label.

Unit aliases are found by a multi-pattern automaton over folded text: the longest alias that ends at
a word's end, of a unit that measures what the label measures. The unit comes from the unit column,
else from the label after its comma, else from beside the number in the evidence; its conversion is
joined from a small fixed table. Values that agree are found by a join on bands of their magnitude.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For each kind of quantity its units' aliases, factor and offset (amount * factor + offset is in the kind's base unit).
UNITS = {
    "pressure": [
        ("па pa pascal паскаль", 1.0, 0.0),
        ("гпа hpa", 1e2, 0.0),
        ("кпа kpa", 1e3, 0.0),
        ("мпа mpa", 1e6, 0.0),
        ("бар bar", 1e5, 0.0),
        ("мбар mbar", 1e2, 0.0),
        ("кгс/см2 kgf/cm2 ат", 98066.5, 0.0),
        ("ммводст ммвст ммводногостолба mmh2o mmwc mmwg", 9.80665, 0.0),
        ("мводст мвст mh2o mwc", 9806.65, 0.0),
        ("ммртст mmhg", 133.322387415, 0.0),
        ("атм atm", 101325.0, 0.0),
        ("psi", 6894.757293168, 0.0),
    ],
    "flow": [
        ("м3/ч м3/час мкуб/ч мкуб/час кубм/ч кубм/час куб/ч m3/h m3/hr cbm/h", 1.0, 0.0),
        ("м3/с м3/сек мкуб/с кубм/с m3/s", 3600.0, 0.0),
        ("м3/мин m3/min", 60.0, 0.0),
        ("л/с л/сек l/s", 3.6, 0.0),
        ("л/мин l/min", 0.06, 0.0),
        ("л/ч л/час l/h", 0.001, 0.0),
        ("тысм3/ч тысм3/час тыскубм/ч тысмкуб/ч", 1000.0, 0.0),
    ],
    "power": [
        ("вт w ватт watt", 1.0, 0.0),
        ("квт kw", 1e3, 0.0),
        ("мвт mw", 1e6, 0.0),
        ("ккал/ч ккал/час kcal/h kcal/hr", 1.163, 0.0),
        ("мкал/ч мкал/час", 1163.0, 0.0),
        ("гкал/ч гкал/час gcal/h", 1.163e6, 0.0),
        ("лс hp", 735.49875, 0.0),
    ],
    "speed": [
        ("м/с м/сек m/s m/sec", 1.0, 0.0),
        ("км/ч км/час km/h kmh kph", 1 / 3.6, 0.0),
        ("м/мин m/min", 1 / 60, 0.0),
        ("м/ч м/час m/h", 1 / 3600, 0.0),
        ("см/с cm/s", 0.01, 0.0),
        ("мм/с mm/s", 0.001, 0.0),
    ],
    "length": [
        ("м m метр meter metre", 1.0, 0.0),
        ("дм dm", 0.1, 0.0),
        ("см cm", 0.01, 0.0),
        ("мм mm", 0.001, 0.0),
        ("км km", 1000.0, 0.0),
        ("мкм um", 1e-6, 0.0),
        ("дюйм inch in", 0.0254, 0.0),
    ],
    "mass": [
        ("кг kg", 1.0, 0.0),
        ("г гр g gr грамм", 0.001, 0.0),
        ("т тн тонн t ton", 1000.0, 0.0),
        ("ц", 100.0, 0.0),
        ("мг mg", 1e-6, 0.0),
    ],
    "temperature": [
        ("°c градc градц градусc градцельсия degc c", 1.0, 0.0),
        ("k кельвин °k", 1.0, -273.15),
        ("°f градf градусf градфаренгейта degf f", 5 / 9, -160 / 9),
    ],
    "share": [
        ("% проц процент процентов pct percent", 1.0, 0.0),
        ("ое долиед дед долиединицы доля", 100.0, 0.0),
        ("‰ промилле", 0.1, 0.0),
        ("ppm", 1e-4, 0.0),
    ],
}
#: Latin letters written for Cyrillic ones of the same look, and the other way round.
_LOOKS = str.maketrans("acekmoptxyh", "асекмортхун")
_DROPPED = ".·"
_NUMBER = re.compile(r"[-−–+]?\d{1,3}(?:[^\S\n]\d{3})+(?!\d)(?:[.,]\d+)?|[-−–+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?")
_PART = re.compile(r"\s*[|;]\s*")


def fold(text: str) -> tuple[str, list[int]]:
    """A text in the automaton's alphabet, and where each of its characters comes from.

    Compatibility forms become plain, letters small, look-alike Latin letters Cyrillic; blanks and
    dots fall away.
    """
    out, at = [], []
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", c).lower():
            if x not in _DROPPED and not x.isspace():
                out.append(x)
                at.append(i)
    return "".join(out).translate(_LOOKS), at


@functools.cache
def alias_table() -> dict[str, list[tuple[str, str, float, float]]]:
    """Folded alias -> (kind, its first alias, factor, offset); an alias may belong to several kinds."""
    table: dict[str, list[tuple[str, str, float, float]]] = {}
    for kind, units in UNITS.items():
        for names, factor, offset in units:
            first = names.split(" ")[0]
            for name in names.split(" "):
                key = fold(name)[0]
                if all(x[0] != kind for x in table.setdefault(key, [])):
                    table[key].append((kind, first, factor, offset))
    return table


@functools.cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for key, units in alias_table().items():
        a.add_word(key, (len(key), {k: first for k, first, _, _ in units}))
    a.make_automaton()
    return a


@functools.lru_cache(100_000)
def whole_unit(text: str | None, kind: str | None) -> str | None:
    """The unit that a text is, if it is one of that kind as a whole."""
    if not text:
        return None
    key = fold(text)[0]
    return next((first for k, first, _, _ in alias_table().get(key, ()) if k == kind), None)


def unit_after(text: str, start: int, kind: str | None) -> str | None:
    """The longest alias of that kind that stands right behind position start, whole words only."""
    end = _PART.search(text, start)
    tail = text[start : end.start() if end else len(text)]
    folded, at = fold(tail)
    best = None
    for last, (size, kinds) in automaton().iter(folded):
        if last - size + 1 == 0 and kind in kinds:
            stop = at[last] + 1
            follows = tail[stop] if stop < len(tail) else " "
            if not follows.isalnum() and follows not in "/°%" and (best is None or size > best[0]):
                best = (size, kinds[kind])
    return best[1] if best else None


def number_of(text: str) -> float:
    return float(re.sub(r"\s", "", text).replace(",", ".").replace("−", "-").replace("–", "-"))


def read_evidence(evidence: str | None, label: str | None, value: float | None, kind: str | None) -> tuple[float | None, str | None]:
    """The value and the unit beside it that an evidence line states.

    The label at its beginning is passed over. Of several numbers the one equal to the given value
    counts, else the first with a unit of the label's kind behind it, else the first.
    """
    if not evidence:
        return None, None
    start = 0
    for name in (label, label.split(",")[0] if label else None):
        if name and evidence.lower().startswith(name.lower()):
            start = len(name)
            break
    found = [(number_of(m[0]), m.end()) for m in _NUMBER.finditer(evidence, start)]
    if not found:
        return None, None
    if value is not None:
        near = [x for x in found if math.isclose(x[0], value, rel_tol=1e-9)]
        pick = near[0] if near else found[0]
        return pick[0], unit_after(evidence, pick[1], kind)
    for amount, end in found:
        if unit := unit_after(evidence, end, kind):
            return amount, unit
    return found[0][0], None


def common_values(values: DataFrame, label_units: DataFrame) -> DataFrame:
    """(value_id, record, label, amount, unit, unit_from, common_unit, common_value).

    record and label are lower-cased, label without the unit after its comma. Identical rows count
    once. A row with a null record or label, of a label without a common unit, without a unit in any
    of the three places or without a number has a null common_value. Infinite values and NaN are
    no numbers. Empty tables give an empty result.
    """
    base = F.lower(F.trim(F.split("label", ",", 2)[0]))
    kind_of = _kinds(label_units)
    goal = kind_of.select(F.col("label").alias("_l"), "common_unit", "kind", F.col("factor").alias("_cf"), F.col("offset").alias("_co"))
    src = values.select("value_id", F.lower(F.trim("record")).alias("record"), base.alias("_base"), F.col("label").alias("_label"), F.col("value").cast("double").alias("value"), "unit", "evidence").dropDuplicates(["value_id"])
    src = src.join(goal, F.col("_base") == F.col("_l"), "left")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            amount, unit, place = [], [], []
            for value, written, label, evidence, kind in zip(*(b.column(n).to_pylist() for n in ("value", "unit", "_label", "evidence", "kind"))):
                v = value if value is not None and math.isfinite(value) else None
                u, p = whole_unit(written, kind), "unit"
                if u is None and label and "," in label:
                    u, p = whole_unit(label.split(",", 1)[1], kind), "label"
                if v is None or u is None:
                    said, beside = read_evidence(evidence, label, v, kind)
                    v = said if v is None else v
                    if u is None:
                        u, p = beside, "evidence"
                amount.append(v)
                unit.append(u)
                place.append(p if u else None)
            yield pa.record_batch([b.column("value_id"), b.column("record"), b.column("_base"), b.column("common_unit"), b.column("kind"), b.column("_cf"), b.column("_co"), pa.array(amount, pa.float64()), pa.array(unit, pa.string()), pa.array(place, pa.string())], ["value_id", "record", "label", "common_unit", "kind", "_cf", "_co", "amount", "unit", "unit_from"])

    schema = "value_id bigint, record string, label string, common_unit string, kind string, _cf double, _co double, amount double, unit string, unit_from string"
    got = src.select("value_id", "record", "_base", "common_unit", "kind", "_cf", "_co", "value", "unit", "_label", "evidence").mapInArrow(resolve, schema)
    factors = values.sparkSession.createDataFrame([(k, n.split(" ")[0], f, o) for k, us in UNITS.items() for n, f, o in us], "kind string, unit string, factor double, offset double")
    # the table of factors is the fixed one above, well under a hundred rows
    out = got.join(F.broadcast(factors), ["kind", "unit"], "left")
    common = (F.col("amount") * F.col("factor") + F.col("offset") - F.col("_co")) / F.col("_cf")
    return out.select("value_id", "record", "label", "amount", "unit", "unit_from", "common_unit", common.alias("common_value"))


def _kinds(label_units: DataFrame) -> DataFrame:
    """The table of labels (a fixed one) with the kind and conversion of each common unit."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for label, unit in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hits = alias_table().get(fold(unit or "")[0], [])
                if label and hits:
                    rows.append((label, unit, hits[0][0], hits[0][2], hits[0][3]))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], ["label", "common_unit", "kind", "factor", "offset"])

    one = label_units.filter("label is not null").groupBy(F.lower(F.trim("label")).alias("label")).agg(F.min("common_unit").alias("common_unit"))
    return one.mapInArrow(find, "label string, common_unit string, kind string, factor double, offset double")


def agreeing(common: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """(value_id_a, value_id_b), a < b: same record and label, values apart by at most tolerance of the larger.

    Values are cut into bands of equal ratio; two that agree lie in the same or neighbouring bands,
    so only those meet, and a record of any size is spread over its bands. Zero agrees with zero.
    """
    v = F.col("common_value")
    width = -math.log1p(-tolerance) * (1 + 1e-6)
    band = F.when(v == 0, F.lit(0).cast("bigint")).otherwise(F.floor(F.log(F.abs(v)) / width))
    side = F.signum(v).cast("int")
    rows = common.filter("common_value is not null and record is not null and label is not null").select("value_id", "record", "label", v.alias("v"), side.alias("side"), band.alias("band"))
    b = rows.select(F.col("value_id").alias("value_id_b"), "record", "label", F.col("v").alias("w"), "side", F.explode(F.when(F.col("side") == 0, F.array("band")).otherwise(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("band"))
    pairs = rows.withColumnRenamed("value_id", "value_id_a").join(b, ["record", "label", "side", "band"])
    near = F.abs(F.col("v") - F.col("w")) <= F.greatest(F.abs("v"), F.abs("w")) * (tolerance + 1e-9)
    return pairs.filter((F.col("value_id_a") < F.col("value_id_b")) & near).select("value_id_a", "value_id_b")
