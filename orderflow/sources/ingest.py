"""Order stream sources and decoding.

The wire format is one JSON object per order (12 fields, all nullable, the
timestamp an ISO string). Production reads Kafka; tests and replays read a
folder of JSON-lines files with the same decoder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, StringType, StructField, StructType)

# The order event contract (field names, order and types).
ORDER_SCHEMA = StructType([
    StructField("order_id", StringType(), True),
    StructField("user_id", StringType(), True),
    StructField("product_id", StringType(), True),
    StructField("product_name", StringType(), True),
    StructField("category", StringType(), True),
    StructField("amount", DoubleType(), True),
    StructField("quantity", IntegerType(), True),
    StructField("payment_method", StringType(), True),
    StructField("ip_address", StringType(), True),
    StructField("device_type", StringType(), True),
    StructField("location_mismatch", IntegerType(), True),
    StructField("timestamp", StringType(), True),
])
REQUIRED_FIELDS = ("order_id", "user_id", "product_id", "category", "amount", "timestamp")
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
CSV_TIMESTAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# Transactions-file layout (16 columns) and its mapping to the order names.
TRANSACTION_COLUMNS = (
    "Transaction ID", "Customer ID", "Transaction Amount", "Transaction Date", "Payment Method",
    "Product Category", "Quantity", "Customer Age", "Customer Location", "Device Used", "IP Address",
    "Shipping Address", "Billing Address", "Account Age Days", "Transaction Hour", "Is Fraudulent",
)
TRANSACTION_RENAMES = {
    "Transaction ID": "order_id",
    "Customer ID": "user_id",
    "Transaction Amount": "order_amount",
    "Transaction Date": "order_timestamp",
    "Device Used": "device_type",
    "Payment Method": "payment_method",
    "Product Category": "category",
    "Is Fraudulent": "is_fraud",
    "Account Age Days": "account_age_days",
    "Transaction Hour": "transaction_hour",
}


def encode_orders(orders: DataFrame) -> DataFrame:
    """Order rows -> ``value`` JSON text in the wire format."""
    payload = F.struct(
        "order_id", "user_id", "product_id", "product_name", "category",
        F.col("amount").cast("double").alias("amount"), F.col("quantity").cast("int").alias("quantity"),
        "payment_method", "ip_address", "device_type",
        F.col("location_mismatch").cast("int").alias("location_mismatch"),
        F.date_format("timestamp", ISO_MICROS).alias("timestamp"),
    )
    return orders.select(F.to_json(payload).alias("value"))


def decode_orders(raw: DataFrame) -> DataFrame:
    """``value`` JSON text -> 12 typed columns; malformed text -> all NULL.

    The timestamp string is parsed leniently (``try_to_timestamp``), so a bad
    value becomes NULL and is caught by the guard instead of failing the job.
    """
    parsed = raw.select(F.from_json(F.col("value").cast("string"), ORDER_SCHEMA).alias("data")).select("data.*")
    return parsed.withColumn("timestamp", F.try_to_timestamp(F.col("timestamp")))


def file_order_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``value`` column from a folder of JSON-lines files."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def kafka_order_stream(spark: SparkSession, bootstrap_servers: str, topic: str = "orders",
                       starting_offsets: str = "latest") -> DataFrame:
    """Streaming ``value`` column from Kafka (needs the Kafka connector on the classpath)."""
    return (spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap_servers)
            .option("subscribe", topic)
            .option("startingOffsets", starting_offsets)
            .load()
            .selectExpr("CAST(value AS STRING) AS value"))


def transactions_layout(staged: DataFrame) -> DataFrame:
    """Orders in the 16-column transactions-file layout (addresses derive from
    the mismatch flag: billing differs from shipping when it is set)."""
    return staged.select(
        F.col("order_id").alias("Transaction ID"),
        F.col("user_id").alias("Customer ID"),
        F.col("order_amount").cast("double").alias("Transaction Amount"),
        F.col("order_timestamp").alias("Transaction Date"),
        F.col("payment_method").alias("Payment Method"),
        F.col("category").alias("Product Category"),
        F.col("quantity").alias("Quantity"),
        F.lit(None).cast("int").alias("Customer Age"),
        F.lit(None).cast("string").alias("Customer Location"),
        F.col("device_type").alias("Device Used"),
        F.col("ip_address").alias("IP Address"),
        F.lit("USA").alias("Shipping Address"),
        F.when(F.col("location_mismatch"), F.lit("mismatch")).otherwise(F.lit("USA")).alias("Billing Address"),
        F.col("account_age_days").alias("Account Age Days"),
        F.hour("order_timestamp").alias("Transaction Hour"),
        F.col("is_fraud").cast("int").alias("Is Fraudulent"),
    )


def map_transaction_schema(tx: DataFrame) -> DataFrame:
    """Transactions layout -> order names; location mismatch from the addresses."""
    renamed = tx.withColumnsRenamed({k: v for k, v in TRANSACTION_RENAMES.items() if k in tx.columns})
    if "Shipping Address" in tx.columns and "Billing Address" in tx.columns:
        mismatch = F.coalesce((F.col("Shipping Address") != F.col("Billing Address")).cast("int"), F.lit(0))
    else:
        mismatch = F.lit(0)
    return renamed.withColumn("location_mismatch", mismatch)


def read_transactions_csv(spark: SparkSession, path: str, sample_fraction: float | None = None,
                          seed: int = 42) -> DataFrame:
    """Transactions CSV with an explicit schema (no inference); optional seeded sample."""
    schema = ("`Transaction ID` STRING, `Customer ID` STRING, `Transaction Amount` DOUBLE, "
              "`Transaction Date` TIMESTAMP, `Payment Method` STRING, `Product Category` STRING, "
              "`Quantity` INT, `Customer Age` INT, `Customer Location` STRING, `Device Used` STRING, "
              "`IP Address` STRING, `Shipping Address` STRING, `Billing Address` STRING, "
              "`Account Age Days` INT, `Transaction Hour` INT, `Is Fraudulent` INT")
    df = spark.read.schema(schema).option("header", "true").option("timestampFormat", CSV_TIMESTAMP).csv(path)
    if sample_fraction is not None:
        df = df.sample(withReplacement=False, fraction=sample_fraction, seed=seed)
    return df
