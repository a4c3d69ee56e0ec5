"""Terms that occur in the driver's invented text."""

PRODUCT_TERMS = ["thing", "ment", "ción"]
UNAVAILABLE_TERMS = ["%%%", "***", "spam", "404"]
URL_TERMS = ["spam-farm", "cheap-pills"]
