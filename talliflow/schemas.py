"""Explicit schemas; nothing is inferred."""

TARGET = (
    "struct<type:string,amount:double,currency:string,category:string,description:string,"
    "date_delta_days:int,date_raw_expression:string>"
)
TARGETS = f"array<{TARGET}>"
GOLDEN = (
    f"input string, conversation_date string, targets {TARGETS}, target {TARGET}, "
    "metadata struct<saved_at:string,source:string,num_transactions:int>"
)
OUTPUT = (
    "struct<type:string,description:string,amount:double,currency:string,category:string,"
    "bot_recorded_date:string,status:string>"
)
CONVERSATION = f"input string, conversation_date string, outputs array<{OUTPUT}>"
PREDICTION = f"input string, raw_response string, parsed_targets {TARGETS}"
CHAT = "messages array<struct<role:string,content:string>>"
#: Keys that every object of a strict answer must have.
REQUIRED_KEYS = ["type", "amount", "currency", "category", "description"]
