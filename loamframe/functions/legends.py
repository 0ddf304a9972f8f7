"""Crop and land-cover legends: lookups, roll-ups and checks of class partitions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamframe.functions.arith import as_col

#: Crop codes; fixed values.
CROPS: Mapping[int, str] = {
    0: "Unknown", 991: "NaN",
    1000: "Cereals", 1100: "Wheat", 1110: "Winter wheat", 1120: "Spring wheat", 1200: "Maize", 1300: "Rice", 1400: "Sorghum",
    1500: "Barley", 1510: "Winter barley", 1520: "Spring barley", 1600: "Rye", 1610: "Winter rye", 1620: "Spring rye", 1700: "Oats",
    1800: "Millets", 1900: "Other cereals", 1910: "Winter cereal", 1920: "Spring cereal",
    2000: "Vegetables and melons", 2100: "Leafy or stem vegetables", 2110: "Artichokes", 2120: "Asparagus", 2130: "Cabages",
    2140: "Cauliflowers & brocoli", 2150: "Lettuce", 2160: "Spinach", 2170: "Chicory", 2190: "Other leafy/stem vegetables",
    2200: "Fruit-bearing vegetables", 2210: "Cucumbers", 2220: "Eggplants", 2230: "Tomatoes", 2240: "Watermelons",
    2250: "Cantaloupes and other melons", 2260: "Pumpkin, squash and gourds", 2290: "Other fruit-bearing vegetables",
    2300: "Root, bulb or tuberous vegetables", 2310: "Carrots", 2320: "Turnips", 2330: "Garlic", 2340: "Onions and shallots",
    2350: "Leeks & other alliaceous vegetables", 2390: "Other root, bulb or tuberous vegetables", 2400: "Mushrooms and truffles", 2900: "Other vegetables",
    3000: "Fruit and nuts", 3100: "Tropical and subtropical fruits", 3110: "Avocados", 3120: "Bananas & plantains", 3130: "Dates", 3140: "Figs",
    3150: "Mangoes", 3160: "Papayas", 3170: "Pineapples", 3190: "Other tropical and subtropical fruits", 3200: "Citrus fruits",
    3210: "Grapefruit & pomelo", 3220: "Lemons & Limes", 3230: "Oranges", 3240: "Tangerines, mandarins, clementines", 3290: "Other citrus fruit",
    3300: "Grapes", 3400: "Berries", 3410: "Currants", 3420: "Gooseberries", 3430: "Kiwi fruit", 3440: "Raspberries", 3450: "Strawberries",
    3460: "Blueberries", 3490: "Other berries", 3500: "Pome fruits and stone fruits", 3510: "Apples", 3520: "Apricots",
    3530: "Cherries & sour cherries", 3540: "Peaches & nectarines", 3550: "Pears & quinces", 3560: "Plums and sloes",
    3590: "Other pome fruits and stone fruits", 3600: "Nuts", 3610: "Almonds", 3620: "Cashew nuts", 3630: "Chestnuts", 3640: "Hazelnuts",
    3650: "Pistachios", 3660: "Walnuts", 3690: "Other nuts", 3900: "Other fruit",
    4000: "Oilseed crops", 4100: "Soya beans", 4200: "Groundnuts", 4300: "Temporary oilseed crops", 4310: "Castor bean", 4320: "Linseed",
    4330: "Mustard", 4340: "Niger seed", 4350: "Rapeseed", 4351: "Winter rapeseed", 4352: "Spring rapeseed", 4360: "Safflower", 4370: "Sesame",
    4380: "Sunflower", 4390: "Other temporary oilseed crops", 4400: "Permanent oilseed crops", 4410: "Coconuts", 4420: "Olives",
    4430: "Oil palms", 4490: "Other oleaginous fruits",
    5000: "Root/tuber crops", 5100: "Potatoes", 5200: "Sweet potatoes", 5300: "Cassava", 5400: "Yams", 5900: "Other roots and tubers",
    6000: "Beverage and spice crops", 6100: "Beverage crops", 6110: "Coffee", 6120: "Tea", 6130: "Maté", 6140: "Cocoa", 6190: "Other beverage crops",
    6200: "Spice crops", 6211: "Chilies & peppers", 6212: "Anise, badian, fennel", 6219: "Other temporary spice crops", 6221: "Pepper",
    6222: "Nutmeg, mace, cardamoms", 6223: "Cinnamon", 6224: "Cloves", 6225: "Ginger", 6226: "Vanilla", 6229: "Other permanent spice crops",
    7000: "Leguminous crops", 7100: "Beans", 7200: "Broad beans", 7300: "Chick peas", 7400: "Cow peas", 7500: "Lentils", 7600: "Lupins",
    7700: "Peas", 7800: "Pigeon peas", 7900: "Other Leguminous crops", 7910: "Other Leguminous crops - Temporary", 7920: "Other Leguminous crops - Permanent",
    8000: "Sugar crops", 8100: "Sugar beet", 8200: "Sugar cane", 8300: "Sweet sorghum", 8900: "Other sugar crops",
    9000: "Other crops", 9100: "Grasses and other fodder crops", 9110: "Temporary grass crops", 9120: "Permanent grass crops", 9200: "Fibre crops",
    9210: "Temporary fibre crops", 9211: "Cotton", 9212: "Jute, kenaf and similar", 9213: "Flax, hemp and similar", 9219: "Other temporary fibre crops",
    9220: "Permanent fibre crops", 9300: "Medicinal, aromatic, pesticidal crops", 9310: "Temporary medicinal etc crops",
    9320: "Permanent medicinal etc crops", 9400: "Rubber", 9500: "Flower crops", 9510: "Temporary flower crops", 9520: "Permanent flower crops",
    9600: "Tobacco", 9900: "Other other crops", 9910: "Other crops - temporary", 9920: "Other crops - permanent", 9998: "mixed cropping",
}

#: Land-cover codes; fixed values.
LAND_COVER: Mapping[str, str] = {
    "A00": "Artificial land", "A10": "Roofed built-up areas", "A20": "Artificial non-built up areas", "A30": "Other artificial areas",
    "B00": "Cropland", "B10": "Cereals", "B20": "Root crops", "B30": "Non-permanent industrial crops", "B40": "Dry pulses, vegetables and flowers",
    "B50": "Fodder crops", "B70": "Permanent crops: fruit trees", "B80": "Other permanent crops",
    "C00": "Woodland", "C10": "Broadleaved woodland", "C20": "Coniferous woodland", "C30": "Mixed woodland",
    "D00": "Shrubland", "D10": "Shrubland with sparse tree cover", "D20": "Shrubland without tree cover",
    "E00": "Grassland", "E10": "Grassland with sparse tree/shrub cover", "E20": "Grassland without tree/shrub cover", "E30": "Spontaneously re-vegetated surfaces",
    "F00": "Bare land and lichens/moss", "F10": "Rocks and stones", "F20": "Sand", "F30": "Lichens and moss", "F40": "Other bare soil",
    "G00": "Water areas", "G10": "Inland water bodies", "G20": "Inland running water", "G30": "Transitional water bodies", "G40": "Sea and ocean",
    "G50": "Glaciers, permanent snow", "H00": "Wetlands", "H10": "Inland wetlands", "H20": "Coastal wetlands",
}

#: Crop codes that stand for others in one national survey; fixed values.
SURVEY_REMAP: Mapping[int, int] = {1100: 1110, 1500: 1510, 1900: 1910}

#: Crops that are classes of their own in training, and groups of cereals and grasses; fixed values.
CLASS_CROPS: tuple[int, ...] = (4351, 1200, 5100, 8100)
WINTER_CEREALS: tuple[int, ...] = (1110, 1510, 1910)
SPRING_CEREALS: tuple[int, ...] = (1120, 1520, 1920)
GRASSES: tuple[int, ...] = (9100, 9110, 9120)


def lookup(c: Column | str, legend: Mapping, default: Column | None = None) -> Column:
    """The legend's entry for c, or the default, null if there is none; for legends of bounded size."""
    pairs = [F.lit(x) for item in legend.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), as_col(c))
    return found if default is None else F.coalesce(found, default)


def lookup_or_fail(c: Column | str, legend: Mapping) -> Column:
    """The legend's entry for c; a value that is missing stops the job."""
    c = as_col(c)
    return F.coalesce(lookup(c, legend), F.when(c.isNotNull(), F.raise_error(F.concat(F.lit("not in the legend: "), c.cast("string")))))


def remap(c: Column | str, mapping: Mapping) -> Column:
    """mapping[c], or c itself."""
    return lookup(c, mapping, default=as_col(c))


def roll_up(code: Column | str) -> Column:
    """Second level of a land-cover code: its first two letters and a 0."""
    return F.concat(F.substring(as_col(code), 1, 2), F.lit("0"))


def legend_table(spark: SparkSession, legend: Mapping[int, str] = CROPS) -> DataFrame:
    return spark.createDataFrame(sorted(legend.items()), "code int, name string")


def crop_codes(names: Iterable[str], legend: Mapping[int, str] = CROPS) -> list[int]:
    """Codes of crops by name; a name that is not in the legend raises."""
    by_name = {name: code for code, name in legend.items()}
    names = list(names)
    missing = sorted(set(names) - set(by_name))
    if missing:
        raise ValueError(f"not in the legend: {missing}")
    return sorted(by_name[name] for name in names)


def split_codes(present: DataFrame, names: Iterable[str], code_col: str = "CT") -> DataFrame:
    """Distinct codes of a table with `relevant`: whether their crop is among the names."""
    chosen = crop_codes(names)
    return present.select(F.col(code_col).alias("code")).where(F.col(code_col).isNotNull()).distinct().withColumn("relevant", F.col("code").isin(chosen))


def class_numbers(classes: Mapping[str, Iterable[str]], legend: Mapping[str, str] = LAND_COVER) -> dict[str, int]:
    """Number of the class of every land-cover code; classes must be disjoint and cover the legend.

    Entries may carry the label after the code.
    """
    numbers: dict[str, int] = {}
    for k, codes in enumerate(classes.values()):
        for code in (c[:3] for c in codes):
            if code in numbers:
                raise ValueError(f"{code} is in more than one class")
            numbers[code] = k
    if missing := sorted(set(legend) - set(numbers)):
        raise ValueError(f"in no class: {missing}")
    return numbers


def training_class(code: Column | str, joint_cereals: bool = False, grass: bool = False) -> Column:
    """Name of the training class of a crop code: cereals apart or as two groups, grasses apart or with the others."""
    code = as_col(code)
    named = [*CLASS_CROPS, *(GRASSES if grass else ()), *(() if joint_cereals else WINTER_CEREALS + SPRING_CEREALS)]
    out = lookup(code, {k: CROPS[k] for k in named})
    if joint_cereals:
        out = F.coalesce(out, F.when(code.isin(*WINTER_CEREALS), "Winter cereals").when(code.isin(*SPRING_CEREALS), "Spring cereals"))
    return F.coalesce(out, F.lit("Other"))
