"""Schemas of the curated tables and the header maps of the CSV feeds."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
D = T.DateType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


TBL_MUNI = _struct(("muni_id", S), ("muni_name", S))
TBL_BARANGAY = _struct(("brgy_id", S), ("brgy_name", S), ("muni_id", S))
FARMER_DEMO = _struct(
    ("f_id", S), ("f_name", S), ("m_name", S), ("l_name", S), ("f_gender", S),
    ("f_birthdate", D), ("f_municipality", S), ("f_barangay", S),
)
QP_FARMER_RAW = _struct(
    ("logs", T.LongType()), ("f_id", S), ("raw_municipality", S), ("raw_barangay", S),
    ("raw_fname", S), ("raw_mname", S), ("raw_lname", S), ("raw_gender", S), ("raw_bdate", D),
    ("raw_area", T.DecimalType(18, 4)), ("raw_population", T.LongType()), ("raw_dgathered", D),
    ("raw_dharvest", D), ("RBSBA", S), ("tenurial", S),
)
HARVEST_DATA = _struct(("Municipality", S), ("Barangay", S), ("Production", T.DecimalType(18, 4)), ("year_gathered", D))
QP_PRICE = _struct(("date", D), ("med_price", T.DecimalType(18, 2)), ("lg_price", T.DecimalType(18, 2)), ("buyer_seller", S))
WEATHER_DATA = _struct(("date", D), ("rain_amount", T.DecimalType(10, 2)), ("note", S))
PESTS = _struct(
    ("id", T.LongType()), ("category", S), ("name", S), ("description", S), ("percent", T.DoubleType()),
    ("rank", T.IntegerType()),
)
SOIL_TEST_KIT = _struct(
    ("first_name", S), ("last_name", S), ("municipality", S), ("area", T.DecimalType(18, 4)), ("sampled", D),
    ("ph", T.DecimalType(10, 4)), ("n", T.DecimalType(10, 4)), ("p", T.DecimalType(10, 4)), ("k", T.DecimalType(10, 4)),
)

# The feeds' CSV headers, exactly as the upload forms read them,
# in file order, with the curated column each one fills.
SURVEY_HEADERS = {
    "Municipalities": "raw_municipality_name",
    "Barangay": "raw_barangay_name",
    "First Name": "raw_fname",
    "Middle Initial": "raw_mname",
    "Last Name": "raw_lname",
    "Gender": "raw_gender",
    "Birthdate": "raw_bdate",
    "Area (Ha)": "raw_area",
    "Population": "raw_population",
    "Date Data Gathered": "raw_dgathered",
    "Stage of Crops": "crop_stage",
    "Date of Harvest": "raw_dharvest",
    "Status": "status",
    "RBSBA": "RBSBA",
    "Contact Number": "contact_number",
    "Tenurial": "tenurial",
}
SOIL_HEADERS = {
    "First Name": "first_name",
    "Last Name": "last_name",
    "Municipality": "municipality",
    "Area(ha)": "area",
    "Date Sampled(D-M-Y)": "sampled",
    "pH": "ph",
    "N": "n",
    "P": "p",
    "K": "k",
}
PRICE_HEADERS = {"DATE": "date", "Medium": "med_price", "Large": "lg_price", "BUYER/SELLER": "buyer_seller"}
HARVEST_HEADERS = {"Municipality": "Municipality", "Barangay": "Barangay", "Production": "Production", "Date": "year_gathered"}
PEST_HEADERS = {
    "Category": "category",
    "Name": "name",
    "Description": "description",
    "Damage": "damage",
    "Management": "management",
    "Report Count": "report_count",
}
