"""Every operator as a named query over the shop's tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import accounts, balances, checks, edits, imports, ledger, payments, payouts, repairs, sales, spending
from ..operators.entries import CONSIGNOR, GIFT, PAYABLE, RECEIVABLE
from ..session import size_shuffles, tune
from ..sources import files, ranges
from ..sources.shop import MANUAL_SALE, Shop
from ..streaming import streams
from . import inputs, journeys

C = F.col
QUERIES: dict[str, Callable[[Shop], DataFrame]] = {}


def query(build: Callable[[Shop], DataFrame]) -> Callable[[Shop], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def bound() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The catalog as functions of a session and a data folder."""
    def bind(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            size_shuffles(tune(spark), sf_dir)
            return build(Shop(spark, sf_dir))

        return run

    return {name: bind(build) for name, build in QUERIES.items()}


# Sources, sinks, bulk load


@query
def load_gift_cards(s: Shop):
    path = inputs.scratch(s)
    files.save_gift_cards(s.gift_cards, path)
    return files.load_gift_cards(s.spark, path)


@query
def import_consignors(s: Shop):
    return accounts.import_consignors(inputs.consignor_staging(s))


@query
def patch_keys(s: Shop):
    return accounts.patch_keys(inputs.consignor_staging(s), inputs.key_fixes(s)).select("ct_id", "name")


@query
def fan_out_accounts(s: Shop):
    return inputs.fanned_out(s).consignors


@query
def fan_out_items(s: Shop):
    return inputs.fanned_out(s).items


@query
def fan_out_vendors(s: Shop):
    return inputs.fanned_out(s).vendors


@query
def fan_out_customers(s: Shop):
    return inputs.fanned_out(s).customers


@query
def import_sales_lines(s: Shop):
    return imports.import_sales_lines(inputs.batch_orders(s), inputs.batch_shipping(s), inputs.staged_sales(s))


@query
def import_all_sales(s: Shop):
    return imports.import_all_sales(inputs.region_orders(s), inputs.region_shipping(s), inputs.unbatched_sales(s))


@query
def import_order_headers(s: Shop):
    return imports.import_order_headers(
        inputs.orders_being_imported(s), s.locations, "2013-01-02 00:00:00", inputs.NOW
    )


@query
def write_ledger(s: Shop):
    path = inputs.scratch(s)
    files.write_ledger(s.postings, path)
    return files.read_ledger(s.spark, path).select(
        "trans_id", "post_date", "ref", "ref_id", "account", "debit", "credit"
    )


@query
def write_ledger_twice(s: Shop):
    """Invoices, then payments, many of the same dates, then the invoices again."""
    path = inputs.scratch(s)
    invoices, paid = (s.postings.filter(C("trans_ref") == ref) for ref in ("invoice", "customer_payment"))
    for postings in (invoices, paid, invoices):
        files.write_ledger(postings, path)
    return files.read_ledger(s.spark, path).select("trans_id", "post_date", "ref", "ref_id", "account", "debit", "credit")


def _closed_ledger(s: Shop) -> str:
    """A stored ledger of the balance accounts with snapshots, one of them made from another."""
    path = inputs.scratch(s)
    files.write_ledger(s.postings_of(CONSIGNOR, PAYABLE), path)
    for day in (dt.date(1996, 1, 1), dt.date(1998, 7, 1)):
        files.take_snapshot(s.spark, path, day)
    return path


@query
def payout_candidates_from_snapshot(s: Shop):
    kept = files.read_balances(s.spark, _closed_ledger(s), inputs.PAY_DATE)
    return payouts.payout_candidates(kept, s.vendors, s.consignors, inputs.PAYOUT_MINIMUM, inputs.PAY_DATE)


@query
def account_list_from_snapshot(s: Shop):
    return balances.account_list(s.consignors, files.read_balances(s.spark, _closed_ledger(s)))


@query
def write_transactions(s: Shop):
    path = inputs.scratch(s)
    files.write_transactions(s.transactions, path)
    return files.read_transactions(s.spark, path)


# Ledger


@query
def invoice_headers(s: Shop):
    return ledger.invoice_headers(s.invoices, s.customers)


@query
def invoice_revenue(s: Shop):
    return ledger.invoice_revenue(s.sold_lines, s.invoices, s.consignors, on="order_id")


@query
def invoice_tax(s: Shop):
    return ledger.invoice_tax(s.sold_lines, s.invoices, on="order_id")


@query
def invoice_receivable(s: Shop):
    return ledger.invoice_receivable(s.sold_lines, s.invoices, on="order_id")


@query
def consignor_share(s: Shop):
    return ledger.consignor_share(s.sold_lines, s.invoices, s.consignors, on="order_id")


@query
def consignor_entries(s: Shop):
    return ledger.consignor_entries(consignor_share(s))


@query
def post_invoices(s: Shop):
    return s.invoice_postings


@query
def ledger_balance_check(s: Shop):
    return ledger.ledger_balance_check(s.postings, ["trans_ref", "trans_ref_id"])


@query
def post_all(s: Shop):
    return ledger.post_all(s.transactions).select("trans_id", "ref", "ref_id", "ref_date", "post_date")


@query
def post_all_count(s: Shop):
    return ledger.count_open(s.transactions)


@query
def repost_with_new_date(s: Shop):
    return journeys.repair_dates(payment_date_repair_set(s), s.transactions).select("trans_id", "ref_date", "post_date")


@query
def post_balanced(s: Shop):
    return ledger.post_balanced(s.transactions, s.postings).transactions.select("trans_id", "ref_date", "post_date")


@query
def post_refused(s: Shop):
    return ledger.post_balanced(s.transactions, s.postings).refused


def _reposted(s: Shop) -> ledger.Posted:
    """Repairs of manual card sales, and of the opening entries, of which many have one side only."""
    openings = s.transactions.filter(C("ref") == "ct_consign").select("trans_id", F.lit("1999-06-01").cast("date").alias("new_date"))
    affected = repairs.affected_transactions(payment_date_repair_set(s), s.transactions)
    dates = affected.select("trans_id", F.to_date("payment_date").alias("new_date")).unionByName(openings)
    return ledger.repost_balanced(s.transactions, dates, s.postings)


@query
def repost_balanced(s: Shop):
    return _reposted(s).transactions.select("trans_id", "ref_date", "post_date")


@query
def repost_refused(s: Shop):
    return _reposted(s).refused


@query
def bill_lines(s: Shop):
    return ledger.bill_lines(inputs.partly_billed_lines(s), s.invoices).select(
        "order_id", "line_number", "item_type", "total_price", "invoice_id", "account"
    )


@query
def rebill_lines(s: Shop):
    return ledger.bill_lines(inputs.partly_billed_lines(s), s.invoices, rebill=True).select(
        "order_id", "line_number", "item_type", "total_price", "invoice_id", "account"
    )


@query
def payment_entries(s: Shop):
    return ledger.payment_entries(s.customer_payments, s.methods)


@query
def voucher_entries(s: Shop):
    return ledger.voucher_entries(payout_voucher_lines(s))


# Balances


@query
def vendor_cash_balance(s: Shop):
    return balances.vendor_cash_balance(s.postings_of(CONSIGNOR))


@query
def customer_credit_balance(s: Shop):
    return balances.customer_credit_balance(s.postings_of(CONSIGNOR))


@query
def balance_all_postings(s: Shop):
    return balances.balance_all_postings(s.postings_of(CONSIGNOR))


@query
def account_list(s: Shop):
    return balances.account_list(s.consignors, s.postings_of(CONSIGNOR))


@query
def account_list_active(s: Shop):
    return balances.account_list(s.consignors, s.postings_of(CONSIGNOR), show_all=False)


@query
def account_statement_total(s: Shop):
    return balances.account_statement_total(s.consignors, s.postings_of(CONSIGNOR))


@query
def gift_card_balance(s: Shop):
    return balances.gift_card_balance(s.gift_cards, s.postings_of(GIFT), inputs.CARD_AMOUNT)


@query
def gift_card_lookup(s: Shop):
    return balances.gift_card_lookup(inputs.entered_codes(s), s.gift_cards)


@query
def ap_balance(s: Shop):
    return balances.ap_balance(s.postings_of(PAYABLE), s.vendors)


@query
def store_credit_available(s: Shop):
    return balances.store_credit_available(s.orders, s.consignors, s.postings_of(CONSIGNOR), s.order_payments, s.methods)


@query
def order_credit_position(s: Shop):
    return balances.order_credit_position(inputs.balances_due(s), s.consignors, s.postings_of(CONSIGNOR))


@query
def consignor_item_revenue(s: Shop):
    return balances.consignor_item_revenue(s.consignors, s.postings)


# Payouts


@query
def payout_candidates(s: Shop):
    return payouts.payout_candidates(s.postings_of(CONSIGNOR), s.vendors, s.consignors, inputs.PAYOUT_MINIMUM, inputs.PAY_DATE)


@query
def payout_review(s: Shop):
    return payouts.payout_review(s.postings_of(CONSIGNOR, PAYABLE), s.vendors, s.consignors, inputs.PAYOUT_MINIMUM, inputs.PAY_DATE)


@query
def payout_voucher_headers(s: Shop):
    return payouts.payout_voucher_headers(payout_candidates(s), inputs.PAY_DATE, inputs.RUN_DATE)


@query
def payout_voucher_lines(s: Shop):
    return payouts.payout_voucher_lines(payout_candidates(s), inputs.RUN_DATE)


@query
def single_payout(s: Shop):
    return payouts.single_payout(s.consignors, s.postings_of(CONSIGNOR), inputs.RUN_DATE)


@query
def manual_adjustment(s: Shop):
    return payouts.manual_adjustment(inputs.adjustments(s), s.consignors)


@query
def convert_account_type(s: Shop):
    return payouts.convert_account_type(inputs.type_changes(s), s.postings_of(CONSIGNOR))


@query
def convert_account_type_unedited_rate(s: Shop):
    return payouts.convert_account_type(inputs.type_changes(s), s.postings_of(CONSIGNOR), unchanged_counts_as_zero=True)


def _edited(s: Shop):
    return edits.apply_edits(inputs.account_edits(s), s.consignors, s.vendors, s.customers)


@query
def edit_accounts(s: Shop):
    return _edited(s).consignors.select(
        "ct_consign_id", "name", "cash", "consign_percent", "consign_fee", "vendor_id", "customer_id"
    )


@query
def edit_accounts_vendors(s: Shop):
    return _edited(s).vendors


@query
def edit_accounts_customers(s: Shop):
    return _edited(s).customers


@query
def edit_accounts_entries(s: Shop):
    return payouts.convert_account_type(_edited(s).type_changes, s.postings_of(CONSIGNOR))


@query
def edit_accounts_entries_unedited_rate(s: Shop):
    return payouts.convert_account_type(_edited(s).type_changes, s.postings_of(CONSIGNOR), unchanged_counts_as_zero=True)


@query
def edit_accounts_log(s: Shop):
    converted = payouts.converted_balances(_edited(s).type_changes, s.postings_of(CONSIGNOR))
    return edits.edit_log(inputs.account_edits(s), s.consignors, converted)


# Checks


def _void_status(s: Shop):
    return checks.check_void_status(s.checks, s.transactions, inputs.CLOSE_DATE)


@query
def open_checks(s: Shop):
    return checks.open_checks(s.checks, s.transactions, s.consignors)


@query
def open_check_transactions(s: Shop):
    return checks.open_check_transactions(s.checks, s.transactions, s.consignors)


@query
def find_check_vouchers(s: Shop):
    return checks.found_check_vouchers(s.checks, s.voucher_checks, inputs.check_numbers(s))


@query
def find_check(s: Shop):
    return checks.find_check(s.checks, s.vendors, s.consignors, s.voucher_checks, inputs.check_numbers(s))


@query
def check_void_status(s: Shop):
    return _void_status(s).select("check_id", "vendor_id", "amount", "trans_id", "status", "period_closed")


@query
def void_check_entries(s: Shop):
    return checks.void_check_entries(_void_status(s))


@query
def void_check_log(s: Shop):
    return checks.void_check_log(_void_status(s))


@query
def checks_to_cancel(s: Shop):
    return checks.checks_to_cancel(s.checks, s.transactions, inputs.check_numbers(s))


@query
def void_check_state(s: Shop):
    return checks.void_check_state(_void_status(s), inputs.now())


def _store_credit(s: Shop):
    return checks.check_to_store_credit(
        _void_status(s), s.consignors, s.customers, s.vouchers, s.voucher_items, s.voucher_checks
    )


@query
def check_to_store_credit(s: Shop):
    return _store_credit(s).entries


@query
def check_to_store_credit_vouchers(s: Shop):
    return _store_credit(s).vouchers.select("voucher_id", "check_id", "vendor_id", "amount")


@query
def check_to_store_credit_items(s: Shop):
    return _store_credit(s).voucher_items


@query
def check_to_store_credit_orders(s: Shop):
    return checks.orders_after_check(s.orders, s.walk_in, inputs.check_moves(_store_credit(s).owners))


# Orders, pricing, payments


@query
def open_orders(s: Shop):
    return sales.open_orders(s.orders, s.lines)


@query
def closed_orders_on(s: Shop):
    return sales.closed_orders_on(s.orders, s.lines, inputs.ORDER_DAY)


@query
def sales_by_location(s: Shop):
    return sales.sales_by_location(s.orders, s.lines, s.locations, inputs.ORDER_DAY)


@query
def payments_by_class(s: Shop):
    return sales.payments_by_class(s.customer_payments, s.methods, inputs.PAYMENT_DAY)


def _dashboard(s: Shop):
    return journeys.dashboard(
        s.orders, s.lines, s.locations, s.customer_payments, s.methods, inputs.ORDER_DAY, inputs.PAYMENT_DAY
    )


@query
def with_grand_total(s: Shop):
    return _dashboard(s)[0]


@query
def payments_with_grand_total(s: Shop):
    return _dashboard(s)[1]


@query
def order_totals(s: Shop):
    return sales.order_totals(s.lines)


@query
def order_balance_due(s: Shop):
    return inputs.balances_due(s).select("order_id", "customer_id", "total", "paid", "balance_due")


@query
def cash_change(s: Shop):
    return payments.cash_change(inputs.tenders(s), inputs.balances_due(s))


@query
def split_store_credit(s: Shop):
    return payments.split_store_credit(inputs.credit_requests(s), store_credit_available(s))


def _named_credit(s: Shop):
    return payments.named_store_credit(
        inputs.named_credit_requests(s), s.orders, s.consignors, s.customers, inputs.walk_ins(s),
        s.postings_of(CONSIGNOR), s.order_payments, s.methods,
    )


@query
def named_store_credit(s: Shop):
    return _named_credit(s).payments


@query
def named_store_credit_customers(s: Shop):
    return _named_credit(s).customers


@query
def named_store_credit_orders(s: Shop):
    return payments.reassign_customer(s.orders, _named_credit(s).moves)


@query
def named_store_credit_rejected(s: Shop):
    return _named_credit(s).rejected


@query
def spend_store_credit(s: Shop):
    return spending.spend_store_credit(
        inputs.credit_requests(s), s.orders, s.consignors, s.postings_of(CONSIGNOR), s.order_payments, s.methods
    ).drop("request_id")


@query
def spend_named_credit(s: Shop):
    return spending.spend_store_credit(
        inputs.named_credit_requests(s), s.orders, s.consignors, s.postings_of(CONSIGNOR), s.order_payments, s.methods
    )


@query
def accumulate_store_credit(s: Shop):
    return payments.accumulate_store_credit(s.order_payments, s.methods)


@query
def merge_duplicate_payments(s: Shop):
    return payments.merge_duplicate_payments(s.order_payments, s.methods)


@query
def merge_duplicate_payment_ids(s: Shop):
    return payments.merged_payment_ids(s.order_payments, s.methods)


@query
def payments_after_merge(s: Shop):
    return payments.payments_after_merge(s.order_payments, s.methods)


@query
def payments_to_process(s: Shop):
    return payments.payments_to_process(s.order_payments, s.methods)


@query
def customer_payments(s: Shop):
    return payments.customer_payments(payments_to_process(s), s.orders, s.customer_payments, inputs.now())


@query
def invoice_payments(s: Shop):
    return payments.invoice_payments(customer_payments(s), s.invoices)


@query
def latest_till(s: Shop):
    return payments.latest_till(s.tills, s.locations)


@query
def till_running_balance(s: Shop):
    return payments.till_running_balance(s.customer_payments, s.methods, s.locations)


@query
def reclass_store_credit_postings(s: Shop):
    return payments.reclass_store_credit_postings(s.postings_of(CONSIGNOR), s.customer_payments, s.consignors)


@query
def apply_order_discount(s: Shop):
    return sales.apply_order_discount(s.lines, inputs.discount_requests(s))


@query
def remove_order_discount(s: Shop):
    return sales.remove_order_discount(s.lines, s.orders)


@query
def apply_order_discount_orders(s: Shop):
    return sales.orders_discounted(s.orders, inputs.discount_requests(s))


@query
def remove_order_discount_orders(s: Shop):
    return sales.orders_without_discount(s.orders)


@query
def toggle_line_discount(s: Shop):
    flag = F.when(C("line_number") % 2 == 0, "add").otherwise("remove")
    return sales.toggle_line_discount(s.lines, s.orders, flag)


@query
def price_sale_lines(s: Shop):
    return sales.price_sale_lines(inputs.scanned_lines(s), inputs.stock(s), s.orders)


@query
def reject_invalid_items(s: Shop):
    return sales.reject_invalid_items(inputs.scanned_lines(s), inputs.stock(s)).select(
        "order_id", "line_number", "item_id"
    )


@query
def allowed_payment_methods(s: Shop):
    return payments.allowed_payment_methods(s.employee_groups, s.method_groups, s.methods)


@query
def allowed_payment_methods_of_one(s: Shop):
    return payments.allowed_payment_methods(s.employee_groups, s.method_groups, s.methods, employee_id=3)


@query
def issue_gift_lines(s: Shop):
    return payments.issue_gift_lines(inputs.gift_requests(s), s.gift_cards, s.orders, s.consignors)


@query
def new_gift_cards(s: Shop):
    return payments.new_gift_cards(inputs.gift_requests(s), s.gift_cards)


@query
def cash_gift_to_account(s: Shop):
    return payments.cash_gift_to_account(
        inputs.card_cash_requests(s), s.orders, s.lines, s.consignors, gift_card_balance(s), gift_method=4
    )


def _cashed(s: Shop):
    return spending.cash_gifts(
        inputs.card_cash_requests(s), s.orders, s.lines, s.consignors, gift_card_balance(s), gift_method=4
    )


@query
def cash_gifts(s: Shop):
    return _cashed(s).gifts


@query
def cash_gifts_rejected(s: Shop):
    return _cashed(s).rejected


@query
def order_worklist(s: Shop):
    positions = balances.order_credit_position(
        inputs.balances_due(s), s.consignors, s.postings_of(CONSIGNOR), keep=sales.WORKLIST_COLUMNS
    )
    return sales.order_worklist(positions, s.walk_in)


@query
def close_orders(s: Shop):
    return sales.close_orders(s.orders, inputs.till_orders(s), inputs.now())


@query
def reassign_customer(s: Shop):
    return payments.reassign_customer(s.orders, inputs.customer_moves(s))


@query
def reassign_customer_payments(s: Shop):
    return payments.payments_after_reassign(
        s.order_payments, s.orders, inputs.customer_moves(s), s.walk_in, s.methods
    ).select("order_payment_id", "order_id", "payment_method_id", "amount")


def _without_till_orders(s: Shop):
    tables = {"orders": s.orders, "lines": s.lines, "payments": s.order_payments, "shipping": s.shipping}
    return sales.drop_orders(tables, inputs.till_orders(s))


@query
def drop_orders(s: Shop):
    return _without_till_orders(s)["orders"].select("order_id", "customer_id")


@query
def drop_orders_lines(s: Shop):
    return _without_till_orders(s)["lines"].select("order_id", "line_number", "item_id", "total_price")


@query
def drop_orders_payments(s: Shop):
    return _without_till_orders(s)["payments"].select("order_payment_id", "order_id", "amount")


@query
def drop_orders_shipping(s: Shop):
    return _without_till_orders(s)["shipping"]


@query
def remove_lines(s: Shop):
    return sales.remove_lines(s.lines, inputs.doomed_lines(s)).select("order_id", "line_number", "item_id", "total_price")


@query
def remove_unprocessed_payments(s: Shop):
    return sales.remove_unprocessed_payments(s.order_payments, inputs.doomed_payments(s)).select(
        "order_payment_id", "order_id", "payment_method_id", "amount"
    )


# Repairs


@query
def name_drift(s: Shop):
    return repairs.name_drift(s.consignors, s.vendors, s.customers)


@query
def name_drift_fixed_vendors(s: Shop):
    return repairs.apply_names(s.vendors, name_drift(s), "vendor", "vendor_id", "name")


@query
def propagate_name_changes(s: Shop):
    return repairs.propagate_name_changes(s.consignors, s.consignors_edited)


@query
def payment_date_repair_set(s: Shop):
    manual = s.lines.drop("invoice_id").filter(C("description") == MANUAL_SALE)
    billed = ledger.bill_lines(manual.withColumn("invoice_id", F.lit(None).cast("bigint")), s.invoices)
    return repairs.payment_date_repair_set(
        billed, s.orders, s.invoices, s.order_payments.drop("deposit_id"), s.customer_payments, s.card_payments,
        MANUAL_SALE,
    )


@query
def apply_dates(s: Shop):
    return repairs.apply_dates(
        s.orders, payment_date_repair_set(s).drop("created_ts"), "order_id", ["created_ts", "order_ts", "close_ts"]
    ).select("order_id", "created_ts", "order_ts", "close_ts")


@query
def apply_dates_invoices(s: Shop):
    return repairs.apply_dates(
        s.invoices, payment_date_repair_set(s).drop("created_ts"), "invoice_id", ["created_ts"]
    ).select("invoice_id", "created_ts")


@query
def apply_dates_payments(s: Shop):
    return repairs.apply_dates(
        s.customer_payments, payment_date_repair_set(s), "customer_payment_id", ["process_ts"]
    ).select("customer_payment_id", "process_ts")


@query
def apply_dates_deposits(s: Shop):
    return repairs.apply_dates(s.deposits, payment_date_repair_set(s), "deposit_id", ["deposit_date"])


@query
def affected_transactions(s: Shop):
    return repairs.affected_transactions(payment_date_repair_set(s), s.transactions)


@query
def misfiled_balances(s: Shop):
    return repairs.misfiled_balances(s.consignors, s.postings_of(CONSIGNOR))


@query
def misfiled_corrections(s: Shop):
    return repairs.misfiled_corrections(misfiled_balances(s))


@query
def ar_reversal(s: Shop):
    return repairs.ar_reversal(s.postings_of(RECEIVABLE))


@query
def ar_reversal_of_day(s: Shop):
    batch = s.invoices.filter(sales.on_day("created_ts", inputs.ORDER_DAY))
    return repairs.ar_reversal(s.postings_of(RECEIVABLE), batch)


@query
def backfill_customers(s: Shop):
    return accounts.backfill_customers(s.consignors, s.customers).select("ct_consign_id", "vendor_id", "customer_id")


@query
def opening_balances(s: Shop):
    return repairs.opening_balances(s.opening_staging, s.consignors.drop("name"))


@query
def gift_opening(s: Shop):
    staged = s.gift_cards.select("legacy_code", "name", "amount", "balance")
    cards = keys.next_ids(s.gift_cards, "gift_card_id", staged, ["legacy_code"], "gift_card_id")
    return repairs.gift_opening(cards.drop("balance"), staged)


@query
def purge_by_ref(s: Shop):
    return repairs.purge_by_ref(s.transactions, s.postings, "deposit")[0].select("trans_id", "ref", "ref_id")


@query
def purge_by_ref_postings(s: Shop):
    return repairs.purge_by_ref(s.transactions, s.postings, "deposit")[1].select(
        "trans_id", "ref", "ref_id", "account", "debit", "credit"
    )


@query
def purge_by_ref_links(s: Shop):
    return repairs.clear_links(s.customer_payments, "deposit_id").select("customer_payment_id", "deposit_id")


@query
def change_log(s: Shop):
    return repairs.change_log(s.consignors, s.consignors_edited)


@query
def account_activity(s: Shop):
    return repairs.account_activity(s.logs, s.notes)


@query
def recent_activity(s: Shop):
    return repairs.recent_activity(s.logs, s.notes, most=10)


# Text, keys, validation


@query
def search_consignors(s: Shop):
    return text.search_consignors(s.consignors, "supplier#0000000(01|02)")


@query
def search_consignors_by_id(s: Shop):
    return text.search_consignors(s.consignors, "7")


@query
def search_json(s: Shop):
    return text.search_json(s.consignors, "supplier#0000000(01|02)")


@query
def legal_name(s: Shop):
    named = inputs.account_requests(s).select("request_id", "name")
    return named.withColumn("legal_name", text.legal_name(C("name")))


@query
def next_ids(s: Shop):
    new = s.order_payments.select("order_payment_id")
    return keys.next_ids(s.orders, "order_id", new, ["order_payment_id"], "order_id")


@query
def reserved_ids(s: Shop):
    """Behind the range of another run; the second call of the run gets the ids of the first."""
    path, new = inputs.scratch(s), s.order_payments.select("order_payment_id")
    ranges.reserve(s.spark, path, "another run", 1000, s.orders, "order_id")
    first, again = (
        ranges.reserved_ids(path, "this run", s.orders, "order_id", new, ["order_payment_id"], "order_id") for _ in range(2)
    )
    return first.intersectAll(again)


@query
def validate_new_accounts(s: Shop):
    return accounts.validate_new_accounts(inputs.account_requests(s)).select(
        "request_id", "name", "cash", "consign_percent", "consign_fee", "missing"
    )


@query
def reject_invalid_discounts(s: Shop):
    return repairs.reject_invalid_discounts(inputs.entered_discounts(s), s.orders)


def _created(s: Shop):
    existing = accounts.Accounts(s.consignors, s.consignors.select("item_id"), s.vendors, s.customers)
    return accounts.create_accounts(inputs.account_requests(s), existing)


@query
def create_accounts(s: Shop):
    return _created(s).consignors


@query
def create_accounts_rejected(s: Shop):
    existing = accounts.Accounts(s.consignors, None, s.vendors, s.customers)
    return accounts.taken_ids(inputs.account_requests(s), existing)


@query
def create_accounts_vendors(s: Shop):
    return _created(s).vendors


# Whole journeys


def _closed(s: Shop):
    latest = payments.latest_till(s.tills, s.locations).filter(~C("must_balance_first"))
    return journeys.close_sales(
        inputs.till_orders(s), s.orders, s.lines, s.order_payments, s.customer_payments, s.invoices, s.consignors,
        s.methods, latest, inputs.now(), s.tills,
    )


@query
def close_sales_postings(s: Shop):
    return _closed(s).postings


@query
def close_sales_tills(s: Shop):
    return _closed(s).tills.select(
        "till_transaction_id", "location_id", "customer_payment_id", "payment_method_id", "cash_balance"
    )


@query
def close_sales_payments(s: Shop):
    return _closed(s).payments.select(
        "customer_payment_id", "order_payment_id", "customer_id", "payment_method_id", "amount", "payment_processor_id",
        "gift_card_id", "till_transaction_id",
    )


@query
def close_sales_order_payments(s: Shop):
    return _closed(s).order_payments.select("order_payment_id", "order_id", "amount", "customer_payment_id")


@query
def close_sales_orders(s: Shop):
    return _closed(s).orders.select("order_id", "order_status", "close_ts")


@query
def close_sales_rejected(s: Shop):
    return _closed(s).rejected


# Streams


@query
def stream_daily_payments(s: Shop):
    return streams.daily_payments_report(s, inputs.scratch(s))


@query
def stream_daily_sums(s: Shop):
    return streams.daily_sums_report(s, inputs.scratch(s))


@query
def stream_name_sync(s: Shop):
    return streams.name_sync_report(s, inputs.scratch(s))


@query
def stream_till_balance(s: Shop):
    return streams.till_balance_report(s, inputs.scratch(s))
