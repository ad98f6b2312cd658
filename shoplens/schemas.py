"""One canonical StructType per entity."""

from __future__ import annotations

from pyspark.sql import types as T

from shoplens import fixed

MONEY = T.DecimalType(12, 2)
VECTOR = T.ArrayType(T.FloatType(), False)
METADATA = T.MapType(T.StringType(), T.StringType())

_PRODUCT_TYPES = {
    "price": MONEY, "salePrice": MONEY, "reviewRating": T.DoubleType(),
    "inStock": T.BooleanType(), "isBundle": T.BooleanType(),
    "isBulk": T.BooleanType(), "isOnSale": T.BooleanType(),
}
_CUSTOMER_TYPES = {
    "accountAgeDays": T.LongType(), "lifetimeOrderCount": T.LongType(),
    "daysSinceLastOrder": T.LongType(), "lifetimeSpend": MONEY,
    "avgOrderValue": MONEY, "emailOptIn": T.BooleanType(),
}


def _struct(names, special) -> T.StructType:
    return T.StructType([T.StructField(n, special.get(n, T.StringType())) for n in names])


PRODUCT = _struct(fixed.PRODUCT_ALIASES, _PRODUCT_TYPES)
CUSTOMER = _struct(fixed.CUSTOMER_ALIASES, _CUSTOMER_TYPES)
INTERACTION = _struct(
    fixed.INTERACTION_ALIASES,
    {"timestamp": T.LongType(), "eventValue": T.DoubleType(),
     "quantity": T.LongType(), "price": MONEY},
)

ORDER_ITEM = T.StructType([
    T.StructField("productId", T.StringType()),
    T.StructField("productName", T.StringType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("price", MONEY),
])
ORDER = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("customerId", T.StringType()),
    T.StructField("customerName", T.StringType()),
    T.StructField("items", T.ArrayType(ORDER_ITEM)),
    T.StructField("total", MONEY),
    T.StructField("status", T.StringType()),
    T.StructField("orderDate", T.DateType()),
    T.StructField("deliveryDate", T.DateType()),
    T.StructField("shippingAddress", T.StringType()),
    T.StructField("notes", T.StringType()),
])

EMBED_RESULT = T.StructType([
    T.StructField("recordId", T.StringType()),
    T.StructField("modelOutput", T.StructType([
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ])),
    T.StructField("error", T.StructType([
        T.StructField("errorCode", T.StringType()),
        T.StructField("errorMessage", T.StringType()),
    ])),
])

VECTOR_RECORD = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("vector", VECTOR),
    T.StructField("metadata", METADATA),
])
