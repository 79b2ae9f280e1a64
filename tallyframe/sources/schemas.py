"""Declared schemas; nothing is inferred from the data.

Fixed values: the column names and types of the input files.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*groups: tuple[T.DataType, tuple[str, ...]]) -> dict[str, T.DataType]:
    return {name: kind for kind, names in groups for name in names}


_TEXT, _DOUBLE, _INT, _LONG, _BOOL = (
    T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(),
)

# In file order; both times are read as text and parsed leniently afterwards.
ACCIDENTS = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in _schema(
            (_TEXT, ("ID", "Source")),
            (_INT, ("Severity",)),
            (_TEXT, ("Start_Time", "End_Time")),
            (_DOUBLE, ("Start_Lat", "Start_Lng", "End_Lat", "End_Lng", "Distance(mi)")),
            (_TEXT, ("Description", "Street", "City", "County", "State", "Zipcode", "Country", "Timezone",
                     "Airport_Code", "Weather_Timestamp")),
            (_DOUBLE, ("Temperature(F)", "Wind_Chill(F)", "Humidity(%)", "Pressure(in)", "Visibility(mi)")),
            (_TEXT, ("Wind_Direction",)),
            (_DOUBLE, ("Wind_Speed(mph)", "Precipitation(in)")),
            (_TEXT, ("Weather_Condition",)),
            (_BOOL, ("Amenity", "Bump", "Crossing", "Give_Way", "Junction", "No_Exit", "Railway", "Roundabout",
                     "Station", "Stop", "Traffic_Calming", "Traffic_Signal", "Turning_Loop")),
            (_TEXT, ("Sunrise_Sunset", "Civil_Twilight", "Nautical_Twilight", "Astronomical_Twilight")),
        ).items()
    ]
)

STORES = T.StructType(
    [
        T.StructField("Store_Number", _INT),
        T.StructField("AreaStore", _DOUBLE),
        T.StructField("Property", _TEXT),
        T.StructField("Type", _TEXT),
        T.StructField("Old/New", _TEXT),
        T.StructField("Checkout Number", _INT),
        T.StructField("Revenue", _LONG),
    ]
)

LEASING_CLIENTS = T.StructType(
    [
        T.StructField("NAME_CLIENT", _TEXT),
        T.StructField("VAL_CREDITS_RON", _DOUBLE),
        T.StructField("DEPOSIT_AMOUNT", _DOUBLE),
        T.StructField("PRESCORING", _DOUBLE),
    ]
)

CLAIMS = T.StructType([T.StructField("Dauna", _TEXT)])

EMPLOYEES = T.StructType(
    [
        T.StructField("id", _INT, False),
        T.StructField("name", _TEXT),
        T.StructField("department", _TEXT),
        T.StructField("salary", _INT),
    ]
)

ORDERS = T.StructType(
    [
        T.StructField("id", _INT, False),
        T.StructField("customer", _TEXT),
        T.StructField("items", T.ArrayType(_TEXT)),
        T.StructField("total", _INT),
        T.StructField("status", _TEXT),
    ]
)
