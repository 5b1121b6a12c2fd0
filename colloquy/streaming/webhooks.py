"""Payment webhooks: projection, matching, routing and the state they lead to.

Each operator takes a batch or a streaming frame.  All per-key state is a commutative
aggregate (min, max, max_by), so late or repeated deliveries lead to the same result and
a hot key is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: event vocabularies and payload paths
ACTIVE_EVENTS = {
    "square": ("payment.updated", "invoice.payment_made"),
    "paypal": (
        "BILLING.SUBSCRIPTION.ACTIVATED",
        "PAYMENT.SALE.COMPLETED",
        "PAYMENT.CAPTURE.COMPLETED",
        "CHECKOUT.ORDER.COMPLETED",
    ),
}
CANCEL_EVENTS = {
    "square": ("invoice.canceled", "subscription.canceled"),
    "paypal": (
        "BILLING.SUBSCRIPTION.CANCELLED",
        "BILLING.SUBSCRIPTION.CANCELED",
        "BILLING.SUBSCRIPTION.SUSPENDED",
    ),
}
REVIEW_EVENTS = {
    "square": (
        "invoice.refunded",
        "invoice.scheduled_charge_failed",
        "refund.created",
        "refund.updated",
    ),
    "paypal": (
        "PAYMENT.SALE.REFUNDED",
        "PAYMENT.SALE.REVERSED",
        "PAYMENT.CAPTURE.REFUNDED",
        "CUSTOMER.DISPUTE.CREATED",
    ),
}
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
ANY_EMAIL = r'"\s*([^"@\s]+@[^"@\s]+\.[^"@\s]+)\s*"'
PAYMENT = "$.data.object.payment"
INVOICE = "$.data.object.invoice"
EMAIL_PATHS = {
    "square": (
        f"{PAYMENT}.note",
        f"{PAYMENT}.reference_id",
        f"{PAYMENT}.buyer_email_address",
        f"{INVOICE}.primary_recipient.email_address",
        f"{INVOICE}.description",
        f"{INVOICE}.title",
    ),
    "paypal": (
        "$.resource.subscriber.email_address",
        "$.resource.payer.email_address",
        "$.resource.payer.payer_info.email",
        "$.resource.custom_id",
        "$.resource.invoice_id",
        "$.resource.payer_email",
        "$.resource.email_address",
    ),
}
ID_PATHS = {
    "square": {
        "order_id": (
            f"{PAYMENT}.order_id",
            f"{PAYMENT}.orderId",
            f"{INVOICE}.order_id",
            f"{INVOICE}.orderId",
        ),
        "payment_id": (f"{PAYMENT}.id", f"{PAYMENT}.payment_id", "$.data.id"),
        "subscription_id": (f"{INVOICE}.subscription_id", f"{INVOICE}.id", f"{INVOICE}.invoice_id"),
        "customer_id": (
            f"{PAYMENT}.customer_id",
            f"{INVOICE}.customer_id",
            f"{INVOICE}.primary_recipient.customer_id",
        ),
    },
    "paypal": {
        "order_id": (),
        "payment_id": ("$.resource.id", "$.resource.parent_payment", "$.resource.capture_id"),
        "subscription_id": (
            "$.resource.billing_agreement_id",
            "$.resource.subscription_id",
            "$.resource.id",
        ),
        "customer_id": ("$.resource.payer_id",),
    },
}
PERIOD_END = "$.resource.billing_info.next_billing_time"


def _first_path(payload: Column, paths: tuple[str, ...]) -> Column:
    found = [F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _by_provider(provider: Column, arms: dict[str, Column]) -> Column:
    out = None
    for name, value in arms.items():
        out = F.when(provider == name, value) if out is None else out.when(provider == name, value)
    return out


def _in_any(provider: Column, kind: Column, table: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(
        _by_provider(provider, {p: kind.isin(*names) for p, names in table.items()}), F.lit(False)
    )


def as_email(value: Column) -> Column:
    clean = F.lower(F.trim(value))
    return F.when(clean.rlike(EMAIL), clean)


def payload_email(provider: Column, payload: Column) -> Column:
    """The first preferred path holding an email, else the first email string anywhere."""
    anywhere = F.lower(F.nullif(F.regexp_extract(payload, ANY_EMAIL, 1), F.lit("")))
    arms = {
        p: F.coalesce(*[as_email(F.get_json_object(payload, x)) for x in paths])
        for p, paths in EMAIL_PATHS.items()
    }
    return F.coalesce(_by_provider(provider, arms), anywhere)


# fixed values: where each provider's payload says which event it is; and what an unnamed type is
IDENTITY_PATHS = {
    "square": (("$.event_id", "$.id"), ("$.type", "$.event_type"), ""),
    "paypal": (("$.id",), ("$.event_type",), "unknown"),
}


def payload_identity(hooks: DataFrame) -> DataFrame:
    """Event id and type as the payload itself tells them, for feeds without such columns."""
    provider, payload = F.col("provider"), F.col("payload_json")

    def first(paths: tuple[str, ...], default: str) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths], F.lit(default))

    return hooks.withColumns(
        {
            "provider_event_id": _by_provider(provider, {p: first(ids, "") for p, (ids, _, _) in IDENTITY_PATHS.items()}),
            "event_type": _by_provider(provider, {p: first(kinds, default) for p, (_, kinds, default) in IDENTITY_PATHS.items()}),
        }
    )


def project_payload(hooks: DataFrame) -> DataFrame:
    """Provider payload to flat columns, by ordered key fallbacks."""
    provider, payload = F.col("provider"), F.col("payload_json")

    def pick(field: str) -> Column:
        return _by_provider(
            provider, {p: _first_path(payload, paths[field]) for p, paths in ID_PATHS.items()}
        ).alias(field)

    return hooks.select(
        *[c for c in hooks.columns if c != "payload_json"],
        payload_email(provider, payload).alias("email"),
        F.upper(F.get_json_object(payload, f"{PAYMENT}.status")).alias("payment_status"),
        pick("order_id"),
        pick("payment_id"),
        pick("subscription_id"),
        pick("customer_id"),
        F.when(
            provider == "paypal", F.try_to_timestamp(F.get_json_object(payload, PERIOD_END))
        )
        .cast("timestamp_ntz")
        .alias("period_end"),
    )


def first_deliveries(hooks: DataFrame) -> DataFrame:
    """One row per (provider, event id), the earliest arrival, with the delivery count.

    A much repeated id is reduced on the map side; nothing is windowed.
    """
    order = F.struct("arrived_at", "event_id", "copy_no")
    cols = [c for c in hooks.columns if c not in ("provider", "provider_event_id")]
    grouped = (
        hooks.filter(F.col("provider_event_id") != "")
        .groupBy("provider", "provider_event_id")
        .agg(
            F.min_by(F.struct(*cols), order).alias("first"),
            F.count(F.lit(1)).alias("deliveries"),
        )
    )
    return grouped.select("provider", "provider_event_id", "first.*", "deliveries")


def delivery_answers(hooks: DataFrame) -> DataFrame:
    """Every delivery with its answer: accepted, duplicate, or ignored for want of an id."""
    order = ["arrived_at", "event_id", "copy_no"]
    named = hooks.filter(F.col("provider_event_id") != "")
    first = named.groupBy("provider", "provider_event_id").agg(F.min(F.struct(*order)).alias("first"))
    told = hooks.join(first, ["provider", "provider_event_id"], "left")
    status = F.when(F.col("first").isNull(), "ignored").when(F.struct(*order) == F.col("first"), "accepted")
    return told.withColumn("status", status.otherwise("duplicate")).drop("first")


def match_users(hooks: DataFrame, users: DataFrame) -> DataFrame:
    """Equi join on the normalized email (mails are unique on the user side)."""
    people = users.groupBy(F.lower(F.trim(F.col("email"))).alias("email")).agg(
        F.min("id").alias("matched_user_id")
    )
    return hooks.join(people, "email", "left")


def route(matched: DataFrame) -> DataFrame:
    """Processed, unmatched, review or ignored, and what the event does."""
    provider, kind = F.col("provider"), F.col("event_type")
    unpaid = (
        (provider == "square")
        & (kind == "payment.updated")
        & (F.coalesce(F.col("payment_status"), F.lit("")) != "COMPLETED")
    )
    activates = _in_any(provider, kind, ACTIVE_EVENTS) & ~unpaid
    cancels = _in_any(provider, kind, CANCEL_EVENTS)
    known = F.col("matched_user_id").isNotNull()
    return matched.withColumn(
        "status",
        F.when(activates & ~known, "unmatched")
        .when(activates | cancels, "processed")
        .when(_in_any(provider, kind, REVIEW_EVENTS), "review")
        .otherwise("ignored"),
    ).withColumn(
        "effect",
        F.when(activates & known, "activate").when(cancels, "cancel").otherwise("none"),
    )


def subscription_key() -> Column:
    """An order id stands in where the payload names no subscription."""
    return F.coalesce(F.col("subscription_id"), F.col("order_id"), F.col("payment_id"))


def subscription_effects(routed: DataFrame) -> DataFrame:
    """The events that move a subscription: one narrow row each, all that its state needs."""
    on, off = F.col("effect") == "activate", F.col("effect") == "cancel"
    return routed.filter(on | off).select(
        "provider",
        subscription_key().alias("subscription_key"),
        F.when(on, F.col("matched_user_id")).alias("user_id"),
        F.struct("ts", "event_id").alias("at"),
        "effect",
    )


def subscription_state(effects: DataFrame) -> DataFrame:
    """One row per (provider, subscription, user), by event time.

    An activation makes or revives its user's row.  A cancel names no user: it hits the row of
    the subscription that was made last before it, and counts if it is later than that user's last
    activation.  The window runs over one subscription's events.
    """
    on = F.col("effect") == "activate"
    mine = ["provider", "subscription_key", "user_id"]
    nth = F.row_number().over(Window.partitionBy(*mine, "effect").orderBy("at"))
    made = F.when(on & (nth == 1), F.col("user_id"))
    so_far = Window.partitionBy("provider", "subscription_key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    hit = effects.withColumn("made", made).withColumn("newest", F.last("made", ignorenulls=True).over(so_far))
    return (
        hit.withColumn("user_id", F.coalesce("user_id", "newest"))
        .where(F.col("user_id").isNotNull())
        .groupBy(*mine)
        .agg(
            F.min(F.when(on, F.col("at.ts"))).alias("activated_at"),
            F.max(F.when(on, F.col("at"))).alias("last_on"),
            F.max(F.when(~on, F.col("at"))).alias("last_off"),
        )
        .select(
            *mine,
            F.when(F.coalesce(F.col("last_off") > F.col("last_on"), F.lit(False)), "canceled").otherwise("active").alias("status"),
            "activated_at",
        )
    )


def match_attempts(hooks: DataFrame, attempts: DataFrame) -> DataFrame:
    """By order id, else by payment id: two equi joins, never one OR join."""
    by_order = attempts.groupBy("provider", F.col("provider_order_id").alias("order_id")).agg(
        F.min("id").alias("attempt_by_order")
    )
    by_payment = (
        attempts.filter(F.col("provider_payment_id").isNotNull())
        .groupBy("provider", F.col("provider_payment_id").alias("payment_id"))
        .agg(F.min("id").alias("attempt_by_payment"))
    )
    return (
        hooks.join(by_order, ["provider", "order_id"], "left")
        .join(by_payment, ["provider", "payment_id"], "left")
        .withColumn(
            "attempt_id", F.coalesce(F.col("attempt_by_order"), F.col("attempt_by_payment"))
        )
        .drop("attempt_by_order", "attempt_by_payment")
    )


def captures(matched: DataFrame) -> DataFrame:
    """Of each attempt the first completion and the newest payment, as a state that merges."""
    paid = matched.filter((F.col("effect") == "activate") & F.col("attempt_id").isNotNull())
    newest = F.max(F.struct("ts", "payment_id")).alias("newest")
    return paid.groupBy("attempt_id").agg(F.min("ts").alias("completed_at"), newest)


def merge_captures(parts: DataFrame) -> DataFrame:
    return parts.groupBy("attempt_id").agg(F.min("completed_at").alias("completed_at"), F.max("newest").alias("newest"))


def with_captures(attempts: DataFrame, state: DataFrame) -> DataFrame:
    """Attempts with what the state says of them."""
    joined = attempts.join(state, attempts["id"] == state["attempt_id"], "left")
    status = F.when(F.col("attempt_id").isNotNull(), "captured").otherwise(F.col("status"))
    paid_by = F.coalesce(F.col("newest.payment_id"), F.col("provider_payment_id"))
    return joined.select("id", "user_id", status.alias("status"), paid_by.alias("provider_payment_id"), "completed_at")


def attempt_state(attempts: DataFrame, matched: DataFrame) -> DataFrame:
    """Captured once a paid event matches, with the first completion time kept."""
    captures = (
        matched.filter((F.col("effect") == "activate") & F.col("attempt_id").isNotNull())
        .groupBy("attempt_id")
        .agg(F.min("ts").alias("completed_at"), F.max_by("payment_id", "ts").alias("paid_by"))
    )
    joined = attempts.join(captures, attempts["id"] == captures["attempt_id"], "left")
    done = F.col("attempt_id").isNotNull()
    return joined.select(
        "id",
        "user_id",
        F.when(done, "captured").otherwise(F.col("status")).alias("status"),
        F.coalesce(F.col("paid_by"), F.col("provider_payment_id")).alias("provider_payment_id"),
        "completed_at",
    )
