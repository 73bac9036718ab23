"""One SQL statement per catalog query, written apart from the Spark code, for the result check."""

from .prelude import PRELUDE

POSTED_LINES = "ref, ref_id, account, CAST(debit AS DECIMAL(20,2)) AS debit, CAST(credit AS DECIMAL(20,2)) AS credit"
FINALS: dict[str, str] = {}

# Sources, sinks, bulk load

FINALS["load_gift_cards"] = "SELECT legacy_code, name, amount, balance FROM m_cards"
FINALS["import_consignors"] = "SELECT * FROM m_imported"
FINALS["patch_keys"] = """
SELECT CASE WHEN ct_id % 10 = 1 THEN ct_id + 500000 ELSE ct_id END AS ct_id, name FROM m_staging"""
FINALS["fan_out_accounts"] = """
SELECT ct_consign_id, name, cash, consign_percent, item_id, CAST(vendor_id AS BIGINT) AS vendor_id,
  CAST(customer_id AS BIGINT) AS customer_id FROM m_fanned"""
FINALS["fan_out_items"] = "SELECT item_id, CAST(ct_consign_id AS VARCHAR) AS name FROM m_fanned"
FINALS["fan_out_vendors"] = """
SELECT CAST(vendor_id AS BIGINT) AS vendor_id, name, CAST(ct_consign_id AS VARCHAR) AS account
FROM m_fanned WHERE cash"""
FINALS["fan_out_customers"] = """
SELECT CAST(customer_id AS BIGINT) AS customer_id, name AS company, CAST(ct_consign_id AS VARCHAR) AS email_phone
FROM m_fanned WHERE NOT cash"""
FINALS["import_sales_lines"] = """
SELECT 900000000 + month_key AS order_id, 'item' AS item_type, 900000001 + month_key AS ship_id,
  (month_key % 25) AS pt_location_id, 1 AS qty, CAST(l_extendedprice AS DECIMAL(10,2)) AS unit_price, l_suppkey AS item_id
FROM (SELECT *, CAST(strftime(l_shipdate, '%Y%m') AS BIGINT) AS month_key FROM lineitem)
WHERE l_linenumber <> 7 AND l_extendedprice <> 0"""
FINALS["import_all_sales"] = """, m_heads AS (
  SELECT CAST(800000000 + r_regionkey AS BIGINT) AS order_id, CAST(3 + r_regionkey AS BIGINT) AS location_id FROM region WHERE r_regionkey <> 4
), m_shipped AS (
  SELECT CAST(800000000 + r_regionkey AS BIGINT) AS order_id, CAST(800000050 + r_regionkey AS BIGINT) AS ship_id FROM region
), m_month AS (
  SELECT s_suppkey AS ct_consign_id, CAST(CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_acctbal END AS DECIMAL(10,2)) AS amount FROM supplier
)
SELECT o.order_id, 'item' AS item_type, s.ship_id, o.location_id AS pt_location_id, 1 AS qty, t.amount AS unit_price, t.ct_consign_id AS item_id
FROM m_heads o JOIN m_shipped s ON o.order_id = s.order_id JOIN m_month t ON t.amount <> 0"""
FINALS["import_order_headers"] = """
SELECT o.order_id, o.location_id, CAST(0 AS DECIMAL(10,2)) AS ship_cost, l.state, l.zipcode,
  TIMESTAMP '2013-01-02' AS invoice_created_ts, 'order' AS order_type, 'closed' AS order_status,
  TIMESTAMP '2002-01-01 12:00:00' AS order_ts, TIMESTAMP '2002-01-01 12:00:00' AS close_ts
FROM m_orders o JOIN m_locations l ON o.location_id = l.location_id WHERE o.order_status = 'pos'"""
FINALS["write_ledger"] = "SELECT trans_id, post_date, ref, ref_id, account, debit, credit FROM m_post"
FINALS["write_ledger_twice"] = """
SELECT trans_id, post_date, ref, ref_id, account, debit, credit FROM m_post WHERE trans_ref IN ('invoice', 'customer_payment')"""
FINALS["write_transactions"] = """
SELECT trans_id, ref, ref_id, ref_date, description, post_date FROM (
  SELECT t.*, CASE WHEN ref = 'ct_consign' AND trans_id % 10 = 3 THEN 'Initial Balance' WHEN ref = 'ct_consign' THEN 'Misfiled'
    WHEN ref = 'check' AND trans_id % 10 = 8 THEN 'Reissued' END AS description FROM m_trans t)"""

# Ledger

FINALS["invoice_headers"] = """
SELECT 'invoice' AS ref, i.invoice_id AS ref_id, CAST(i.created_ts AS DATE) AS ref_date,
  (SELECT c.company FROM m_customers c WHERE c.customer_id = i.customer_id) AS description
FROM m_invoices i"""
FINALS["invoice_revenue"] = """
SELECT invoice_id, ref_date, ref, ref_id, account, CAST(0 AS DECIMAL(20,2)) AS debit, amount AS credit FROM m_revenue"""
FINALS["invoice_tax"] = """
SELECT invoice_id, ref_date, CAST(NULL AS VARCHAR) AS ref, CAST(NULL AS BIGINT) AS ref_id, 'tax' AS account,
  CAST(0 AS DECIMAL(20,2)) AS debit, tax AS credit FROM m_whole WHERE tax <> 0"""
FINALS["invoice_receivable"] = """
SELECT invoice_id, ref_date, 'customer' AS ref, invoice_customer AS ref_id, 'ar' AS account, amount AS debit,
  CAST(0 AS DECIMAL(20,2)) AS credit FROM m_whole"""
FINALS["consignor_share"] = "SELECT invoice_id, ref_date, ref, ref_id, amount FROM m_share"
FINALS["consignor_entries"] = """
SELECT invoice_id, ref_date, ref, ref_id, a.account, CASE WHEN a.account = 'cogs' THEN amount ELSE 0 END AS debit,
  CASE WHEN a.account = 'cc' THEN amount ELSE 0 END AS credit
FROM m_share, (VALUES ('cc'), ('cogs')) a(account)"""
FINALS["post_invoices"] = f"SELECT invoice_id, ref_date, {POSTED_LINES} FROM m_inv"
FINALS["ledger_balance_check"] = """
SELECT trans_ref, trans_ref_id, CAST(sum(debit) AS DECIMAL(20,2)) AS debit, CAST(sum(credit) AS DECIMAL(20,2)) AS credit
FROM m_post GROUP BY trans_ref, trans_ref_id HAVING sum(debit) <> sum(credit)"""
FINALS["post_all"] = "SELECT trans_id, ref, ref_id, ref_date, ref_date AS post_date FROM m_trans"
FINALS["post_all_count"] = "SELECT count(*) AS posted FROM m_trans WHERE post_date IS NULL"
FINALS["affected_transactions"] = """
SELECT t.trans_id, r.payment_date FROM m_repair r JOIN m_trans t ON t.ref = 'invoice' AND t.ref_id = r.invoice_id
UNION ALL
SELECT t.trans_id, r.payment_date FROM m_repair r JOIN m_trans t ON t.ref = 'customer_payment' AND t.ref_id = r.customer_payment_id
UNION ALL
SELECT t.trans_id, r.payment_date FROM m_repair r JOIN m_trans t ON t.ref = 'deposit' AND t.ref_id = r.deposit_id"""
FINALS["repost_with_new_date"] = """
SELECT t.trans_id, coalesce(n.d, t.ref_date) AS ref_date, coalesce(n.d, t.post_date) AS post_date
FROM m_trans t LEFT JOIN (
  SELECT ref, ref_id, CAST(min(payment_date) AS DATE) AS d FROM (
    SELECT payment_date, unnest(['invoice', 'customer_payment', 'deposit']) AS ref,
      unnest([invoice_id, customer_payment_id, deposit_id]) AS ref_id FROM m_repair
  ) GROUP BY ref, ref_id
) n ON t.ref = n.ref AND t.ref_id = n.ref_id"""
GATE = """, m_sums AS (
  SELECT t.trans_id, t.ref, t.ref_id, t.ref_date, t.post_date, CAST(coalesce(p.d, 0) AS DECIMAL(20,2)) AS debit,
    CAST(coalesce(p.c, 0) AS DECIMAL(20,2)) AS credit
  FROM m_trans t LEFT JOIN (SELECT trans_id, sum(debit) AS d, sum(credit) AS c FROM m_post GROUP BY trans_id) p ON p.trans_id = t.trans_id
), m_redated AS (
  SELECT s.*, n.d AS new_date FROM m_sums s LEFT JOIN (
    SELECT ref, ref_id, CAST(min(payment_date) AS DATE) AS d FROM (
      SELECT payment_date, unnest(['invoice', 'customer_payment', 'deposit']) AS ref,
        unnest([invoice_id, customer_payment_id, deposit_id]) AS ref_id FROM m_repair
    ) GROUP BY ref, ref_id
    UNION ALL SELECT DISTINCT 'ct_consign', ref_id, DATE '1999-06-01' FROM m_trans WHERE ref = 'ct_consign'
  ) n ON s.ref = n.ref AND s.ref_id = n.ref_id
)"""
FINALS["post_balanced"] = f"""{GATE}
SELECT trans_id, ref_date, CASE WHEN post_date IS NULL AND debit = credit THEN ref_date ELSE post_date END AS post_date FROM m_sums"""
FINALS["post_refused"] = f"{GATE} SELECT trans_id, ref, ref_id, debit, credit FROM m_sums WHERE post_date IS NULL AND debit <> credit"
FINALS["repost_balanced"] = f"""{GATE}
SELECT trans_id, coalesce(new_date, ref_date) AS ref_date,
  CASE WHEN new_date IS NULL THEN post_date WHEN debit = credit THEN new_date END AS post_date FROM m_redated"""
FINALS["repost_refused"] = f"""{GATE}
SELECT trans_id, ref, ref_id, debit, credit FROM m_redated WHERE new_date IS NOT NULL AND debit <> credit"""
FINALS["bill_lines"] = """
SELECT l.order_id, l.line_number, l.item_type, l.total_price,
  CASE WHEN l.line_number = 7 THEN -1 ELSE i.invoice_id END AS invoice_id,
  CASE WHEN l.line_number = 7 THEN 'other' WHEN i.invoice_id IS NOT NULL THEN 'sales' END AS account
FROM m_lines l LEFT JOIN m_invoices i ON l.order_id = i.order_id"""
FINALS["rebill_lines"] = """
SELECT l.order_id, l.line_number, l.item_type, l.total_price,
  CASE WHEN i.invoice_id IS NOT NULL THEN i.invoice_id WHEN l.line_number = 7 THEN -1 END AS invoice_id,
  CASE WHEN i.invoice_id IS NOT NULL THEN 'sales' WHEN l.line_number = 7 THEN 'other' END AS account
FROM m_lines l LEFT JOIN m_invoices i ON l.order_id = i.order_id"""
FINALS["payment_entries"] = f"""
SELECT 'customer_payment' AS trans_ref, customer_payment_id AS trans_ref_id, ref_date, {POSTED_LINES} FROM m_pay"""
FINALS["voucher_entries"] = """
SELECT vendor_id, ref_num, ref, ref_id, account, unit_cost AS debit, CAST(0 AS DECIMAL(20,2)) AS credit
FROM m_voucher_lines
UNION ALL
SELECT vendor_id, ref_num, 'vendor', vendor_id, 'ap', 0, CAST(sum(unit_cost) AS DECIMAL(20,2))
FROM m_voucher_lines GROUP BY vendor_id, ref_num"""

# Balances

FINALS["vendor_cash_balance"] = """
SELECT ref_id AS vendor_id, posted AS balance FROM m_bal
WHERE ref = 'vendor' AND account = 'cc' AND posted IS NOT NULL"""
FINALS["customer_credit_balance"] = """
SELECT ref_id AS customer_id, posted AS balance FROM m_bal
WHERE ref = 'customer' AND account = 'cc' AND posted IS NOT NULL"""
FINALS["balance_all_postings"] = """
SELECT ref, ref_id, held AS balance FROM m_bal WHERE ref IN ('vendor', 'customer') AND account = 'cc'"""
FINALS["account_list"] = """
SELECT ct_consign_id, name, cash, vendor_id, customer_id, v_posted AS cash_balance, c_posted AS credit_balance,
  CAST(coalesce(v_posted, 0) + coalesce(c_posted, 0) AS DECIMAL(20,2)) AS total_balance FROM m_side"""
FINALS["account_list_active"] = FINALS["account_list"] + " WHERE inactive_ts IS NULL"
FINALS["account_statement_total"] = """
SELECT ct_consign_id,
  CAST(CASE WHEN vendor_id IS NOT NULL THEN coalesce(v_posted, 0) END AS DECIMAL(20,2)) AS cash_balance,
  CAST(CASE WHEN customer_id IS NOT NULL THEN coalesce(c_posted, 0) END AS DECIMAL(20,2)) AS credit_balance,
  CAST(CASE WHEN customer_id IS NOT NULL AND vendor_id IS NOT NULL THEN coalesce(v_posted, 0) + coalesce(c_posted, 0) END
    AS DECIMAL(20,2)) AS total_balance
FROM m_side"""
FINALS["gift_card_balance"] = """
SELECT g.gift_card_id, g.legacy_code, g.name, g.amount, b.posted AS balance,
  500.00 > coalesce(b.posted, 0) AS no_balance, coalesce(b.posted, 0) > 0 AS available
FROM m_cards g LEFT JOIN m_bal b ON b.ref = 'gift_card' AND b.account = 'gift' AND b.ref_id = g.gift_card_id"""
FINALS["gift_card_lookup"] = """
SELECT e.request_id, e.code, coalesce(i.gift_card_id, o.gift_card_id) AS gift_card_id
FROM (
  SELECT event_id AS request_id, CASE event_id % 4 WHEN 0 THEN n WHEN 1 THEN lpad(n, 6, '0') WHEN 2 THEN 'X' || n
    ELSE '9999999999999999999' || n END AS code
  FROM (SELECT event_id, CAST(event_id % 150 * 20 AS VARCHAR) AS n FROM events)
) e
  LEFT JOIN m_cards i ON regexp_full_match(e.code, '[0-9]+') AND TRY_CAST(e.code AS BIGINT) = i.gift_card_id
  LEFT JOIN m_cards o ON e.code = o.legacy_code"""
FINALS["ap_balance"] = """
SELECT ref_id AS vendor_id, posted AS balance FROM m_bal
WHERE ref = 'vendor' AND account = 'ap' AND posted <> 0 AND ref_id IN (SELECT vendor_id FROM m_vendors)"""
FINALS["store_credit_available"] = "SELECT * FROM m_avail"
FINALS["order_credit_position"] = "SELECT * FROM m_position"
FINALS["consignor_item_revenue"] = """
SELECT c.ct_consign_id, c.name, c.item_id, CAST(sum(p.credit) AS DECIMAL(20,2)) AS revenue
FROM m_consign c JOIN m_post p ON p.ref = 'item' AND p.ref_id = c.item_id GROUP BY ALL"""

# Payouts

FINALS["payout_candidates"] = "SELECT * FROM m_payout"
FINALS["payout_candidates_from_snapshot"] = FINALS["payout_candidates"]
FINALS["account_list_from_snapshot"] = FINALS["account_list"]
FINALS["payout_review"] = """
SELECT p.vendor_id, p.name, b.posted AS ap_amount, p.amount, FALSE AS is_total
FROM m_payout p LEFT JOIN m_bal b ON b.ref = 'vendor' AND b.account = 'ap' AND b.ref_id = p.vendor_id AND b.posted <> 0
UNION ALL
SELECT NULL, NULL, NULL, CAST(sum(amount) AS DECIMAL(20,2)), TRUE FROM m_payout"""
FINALS["payout_voucher_headers"] = """
SELECT vendor_id, DATE '1998-12-31' AS voucher_date, CAST(vendor_id AS VARCHAR) || '-1999-01-02' AS ref_num,
  'new' AS voucher_status FROM m_payout"""
FINALS["payout_voucher_lines"] = "SELECT * FROM m_voucher_lines"
FINALS["single_payout"] = """
SELECT ct_consign_id, vendor_id, DATE '1999-01-02' AS voucher_date, CAST(vendor_id AS VARCHAR) || '-1999-01-02' AS ref_num,
  'Consignment' AS description, 'vendor' AS ref, vendor_id AS ref_id, 'cc' AS account, 1 AS qty,
  CAST(coalesce(v_held, 0) AS DECIMAL(20,2)) AS unit_cost
FROM m_side WHERE vendor_id IS NOT NULL"""
FINALS["manual_adjustment"] = """
SELECT x.ref AS trans_ref, x.ref_id AS trans_ref_id, x.description, x.ref, x.ref_id, a.account,
  CASE WHEN a.account = 'cogs' THEN amount ELSE 0 END AS debit, CASE WHEN a.account = 'cc' THEN amount ELSE 0 END AS credit
FROM (
  SELECT 'vendor' AS ref, vendor_id AS ref_id, 'Manual Cash Adjustment' AS description, CAST(s_acctbal AS DECIMAL(20,2)) AS amount
  FROM m_consign JOIN supplier ON s_suppkey = ct_consign_id WHERE cash AND vendor_id IS NOT NULL AND ct_consign_id % 2 = 0
  UNION ALL
  SELECT 'customer', customer_id, 'Manual Credit Adjustment', CAST(s_acctbal AS DECIMAL(20,2))
  FROM m_consign JOIN supplier ON s_suppkey = ct_consign_id WHERE NOT cash AND customer_id IS NOT NULL AND ct_consign_id % 2 = 1
) x, (VALUES ('cc'), ('cogs')) a(account)"""


# Every account, with the ids it will have once it changes its type.
ALL_CONVERTED = """(
        SELECT m.*, coalesce(m.vendor_id, (SELECT max(vendor_id) FROM m_vendors)
          + row_number() OVER (PARTITION BY m.vendor_id IS NULL ORDER BY m.ct_consign_id)) AS full_vendor
        FROM m_filled m
      )"""


def _converted(new_rate: str, accounts: str) -> str:
    """Balances in whole cents and rates in ten-thousandths, so that rounding is exact."""
    return f"""(
  SELECT *, CAST(sign(old_cents) * ((2 * abs(old_cents) * num + den) // (2 * den)) AS DECIMAL(20,0)) * 0.01 AS new_balance
  FROM (
    SELECT *, CAST(old_balance * 100 AS HUGEINT) AS old_cents,
      CASE WHEN d > 0 THEN 10000 + d ELSE 10000 END AS num, CASE WHEN d > 0 THEN 10000 ELSE 10000 - d END AS den
    FROM (
      SELECT f.*, b.ref AS old_ref, b.held AS old_balance,
        CAST(({new_rate}) * 10000 AS INTEGER) - CAST(f.consign_percent * 10000 AS INTEGER) AS d
      FROM {accounts} f JOIN m_bal b ON b.account = 'cc' AND b.ref = CASE WHEN f.cash THEN 'vendor' ELSE 'customer' END
        AND b.ref_id = CASE WHEN f.cash THEN f.full_vendor ELSE f.customer_id END
      WHERE b.held <> 0
    )
  )
)"""


def _conversion(new_rate: str, accounts: str = ALL_CONVERTED) -> str:
    return f"""
SELECT 'ct_consign' AS trans_ref, ct_consign_id AS trans_ref_id, 'Transfer account balance' AS description,
  e.ref, e.ref_id, e.account, CAST(e.debit AS DECIMAL(20,2)) AS debit, CAST(e.credit AS DECIMAL(20,2)) AS credit
FROM {_converted(new_rate, accounts)} x, LATERAL (
  SELECT old_ref AS ref, CASE WHEN cash THEN full_vendor ELSE customer_id END AS ref_id, 'cc' AS account,
    old_balance AS debit, 0 AS credit
  UNION ALL SELECT CASE WHEN cash THEN 'customer' ELSE 'vendor' END,
    CASE WHEN cash THEN customer_id ELSE full_vendor END, 'cc', 0, new_balance
  UNION ALL SELECT NULL, NULL, 'cogs', new_balance - old_balance, 0 WHERE new_balance <> old_balance
) e"""


FINALS["convert_account_type"] = _conversion(
    "f.consign_percent + CASE f.ct_consign_id % 3 WHEN 0 THEN 0.025 WHEN 1 THEN -0.025 ELSE 0 END"
)
FINALS["convert_account_type_unedited_rate"] = _conversion(
    "CASE f.ct_consign_id % 3 WHEN 0 THEN f.consign_percent + 0.025 WHEN 1 THEN f.consign_percent - 0.025 ELSE 0 END"
)

# The forms typed by rule: a fee for each 13th account, other types for each 7th, rates for each 11th, names for each 5th.
EDITS = """, m_forms AS (
  SELECT ct_consign_id, cash, consign_percent, vendor_id, customer_id,
    ct_consign_id % 7 = 0 AS retyped, ct_consign_id % 11 = 0 AS rerated,
    ct_consign_id % 13 = 0 AS fee_set, name AS old_name,
    ct_consign_id % 5 = 0 OR ct_consign_id % 7 = 0 OR ct_consign_id % 11 = 0 OR ct_consign_id % 13 = 0 AS edited, consign_fee
  FROM m_consign
), m_kept AS (
  SELECT f.*, e.name AS new_name, e.cash AS new_cash,
    CASE WHEN fee_set THEN CAST(0 AS DECIMAL(5,4)) ELSE e.consign_percent END AS new_percent,
    CASE WHEN fee_set THEN e.consign_fee WHEN NOT edited THEN f.consign_fee END AS new_fee,
    coalesce(f.vendor_id, CASE WHEN retyped AND NOT f.cash THEN (SELECT max(vendor_id) FROM m_vendors)
      + row_number() OVER (PARTITION BY f.vendor_id IS NULL AND retyped AND NOT f.cash ORDER BY f.ct_consign_id) END) AS full_vendor,
    coalesce(f.customer_id, CASE WHEN retyped AND f.cash THEN (SELECT max(customer_id) FROM m_customers)
      + row_number() OVER (PARTITION BY f.customer_id IS NULL AND retyped AND f.cash ORDER BY f.ct_consign_id) END) AS full_customer
  FROM m_forms f JOIN m_edited e ON f.ct_consign_id = e.ct_consign_id
), m_turned AS (
  SELECT ct_consign_id, cash, consign_percent, new_percent, full_vendor, full_customer AS customer_id FROM m_kept WHERE retyped
)"""
FINALS["edit_accounts"] = f"""{EDITS}
SELECT ct_consign_id, new_name AS name, new_cash AS cash, new_percent AS consign_percent, new_fee AS consign_fee,
  full_vendor AS vendor_id, full_customer AS customer_id FROM m_kept"""
FINALS["edit_accounts_vendors"] = f"""{EDITS}
SELECT full_vendor AS vendor_id, old_name AS name, CAST(ct_consign_id AS VARCHAR) AS account
FROM m_kept WHERE vendor_id IS NULL AND full_vendor IS NOT NULL"""
FINALS["edit_accounts_customers"] = f"""{EDITS}
SELECT full_customer AS customer_id, old_name AS company FROM m_kept WHERE customer_id IS NULL AND full_customer IS NOT NULL"""
FINALS["edit_accounts_entries"] = EDITS + _conversion("f.new_percent", "m_turned")
FINALS["edit_accounts_entries_unedited_rate"] = EDITS + _conversion(
    "CASE WHEN f.ct_consign_id % 11 = 0 THEN f.new_percent ELSE 0 END", "m_turned"
)
FINALS["edit_accounts_log"] = f"""{EDITS}
SELECT ct_consign_id, 'Converted ' || CASE WHEN cash THEN 'cash' ELSE 'credit' END || ' balance of '
  || CAST(CAST(old_balance AS DECIMAL(20,2)) AS VARCHAR) || ' to ' || CASE WHEN cash THEN 'credit' ELSE 'cash' END || ' balance of '
  || CAST(CAST(new_balance AS DECIMAL(20,2)) AS VARCHAR) || ' (change of '
  || CAST(CAST(new_balance - old_balance AS DECIMAL(20,2)) AS VARCHAR) || ')' AS message
FROM {_converted("f.new_percent", "m_turned")}
UNION ALL
SELECT ct_consign_id, message FROM ({{changes}})"""

# Checks

FINALS["open_checks"] = """
SELECT c.check_id, c.vendor_id, c.check_num, c.check_date, c.amount, coalesce(t.n, 0) AS n_transactions
FROM m_checks c LEFT JOIN (
  SELECT ref_id, count(*) AS n FROM m_trans WHERE ref = 'check' GROUP BY ref_id
) t ON t.ref_id = c.check_id
WHERE c.cleared IS NULL AND c.vendor_id IN (SELECT vendor_id FROM m_consign WHERE vendor_id IS NOT NULL)"""
FINALS["open_check_transactions"] = """
SELECT c.check_id, t.trans_id FROM m_checks c JOIN m_trans t ON t.ref = 'check' AND t.ref_id = c.check_id
WHERE c.cleared IS NULL AND c.vendor_id IN (SELECT vendor_id FROM m_consign WHERE vendor_id IS NOT NULL)"""
FINALS["find_check_vouchers"] = """
SELECT v.check_id, v.voucher_id FROM m_vouchers v JOIN m_checks c ON c.check_id = v.check_id
WHERE c.check_num IN (SELECT order_id + 5000 FROM m_orders)"""
FINALS["find_check"] = """
SELECT c.check_id, c.check_num, c.check_date, c.amount, c.vendor_id, o.customer_id, o.ct_consign_id,
  v.name AS payee, o.name AS consignor, l.n AS n_vouchers
FROM m_checks c JOIN m_vendors v ON c.vendor_id = v.vendor_id JOIN m_consign o ON c.vendor_id = o.vendor_id
  JOIN (SELECT check_id, count(*) AS n FROM m_vouchers GROUP BY check_id) l ON l.check_id = c.check_id"""
FINALS["check_void_status"] = """
SELECT check_id, vendor_id, amount, trans_id, status,
  CASE WHEN trans_id IS NOT NULL THEN coalesce(post_date <= DATE '1998-06-30', FALSE) END AS period_closed FROM m_void"""
FINALS["void_check_entries"] = """
SELECT 'check' AS trans_ref, check_id AS trans_ref_id, 'Void and cancel check' AS description, 'vendor' AS ref,
  vendor_id AS ref_id, a.account, CASE WHEN a.account = 'bank' THEN amount ELSE 0 END AS debit,
  CASE WHEN a.account = 'cogs' THEN amount ELSE 0 END AS credit,
  CASE WHEN a.account = 'cogs' THEN 'void check' END AS memo
FROM m_void, (VALUES ('bank'), ('cogs')) a(account) WHERE status = 'voidable'"""
FINALS["void_check_log"] = """
SELECT 'check' AS ref, check_id AS ref_id, 'Check voided and canceled' AS message FROM m_void WHERE status = 'voidable'"""
FINALS["checks_to_cancel"] = """
SELECT c.check_id, c.check_num, c.check_date, c.vendor_id, c.amount, t.trans_id
FROM m_checks c LEFT JOIN m_trans t ON t.ref = 'check' AND t.ref_id = c.check_id"""
FINALS["void_check_state"] = """
SELECT check_id, vendor_id, amount, status = 'voidable' AS closed,
  CASE WHEN status = 'voidable' THEN NULL ELSE cleared END AS cleared,
  CASE WHEN status = 'voidable' THEN TIMESTAMP '2002-01-01 12:00:00' END AS void_ts,
  CASE WHEN status = 'voidable' THEN check_num END AS void_check_num,
  CASE WHEN status <> 'voidable' THEN check_num END AS check_num
FROM m_void"""
# Only owners of voidable checks get a customer here, so they are numbered among themselves.
_OWNERS = """(
  SELECT ct_consign_id, vendor_id, coalesce(customer_id, (SELECT max(customer_id) FROM m_customers)
    + row_number() OVER (PARTITION BY customer_id IS NULL ORDER BY ct_consign_id)) AS customer_id
  FROM m_consign WHERE vendor_id IN (SELECT vendor_id FROM m_void WHERE status = 'voidable'))"""
FINALS["check_to_store_credit"] = f"""
SELECT v.check_id, 'ct_consign' AS trans_ref, o.ct_consign_id AS trans_ref_id,
  'Convert Check to Customer Credit' AS description, e.ref,
  CAST(CASE WHEN e.ref = 'vendor' THEN o.vendor_id ELSE o.customer_id END AS BIGINT) AS ref_id, 'cc' AS account,
  CASE WHEN e.ref = 'vendor' THEN v.amount ELSE 0 END AS debit, CASE WHEN e.ref = 'customer' THEN v.amount ELSE 0 END AS credit
FROM m_void v JOIN {_OWNERS} o ON v.vendor_id = o.vendor_id, (VALUES ('vendor'), ('customer')) e(ref)
WHERE v.status = 'voidable'"""
_GONE = """(
  SELECT v.voucher_id FROM m_vouchers v JOIN m_void c ON v.check_id = c.check_id
  WHERE c.status = 'voidable' AND c.vendor_id IN (SELECT vendor_id FROM m_consign WHERE vendor_id IS NOT NULL))"""
FINALS["check_to_store_credit_vouchers"] = f"""
SELECT voucher_id, check_id, vendor_id, amount FROM m_vouchers WHERE voucher_id NOT IN {_GONE}"""
FINALS["check_to_store_credit_items"] = f"""
SELECT voucher_id, 1 AS line_number, amount AS unit_cost FROM m_vouchers WHERE voucher_id NOT IN {_GONE}"""
FINALS["check_to_store_credit_orders"] = f"""
SELECT o.order_id, CAST(CASE WHEN o.customer_id = 1 THEN coalesce(k.customer_id, 1) ELSE o.customer_id END AS BIGINT) AS customer_id
FROM m_orders o LEFT JOIN (
  SELECT v.check_id, min(w.customer_id) AS customer_id FROM m_void v JOIN {_OWNERS} w ON v.vendor_id = w.vendor_id
  WHERE v.status = 'voidable' GROUP BY v.check_id
) k ON k.check_id = o.order_id"""

# Orders, pricing, payments

FINALS["open_orders"] = """
SELECT o.order_id, o.location_id, o.customer_id, o.created_ts, t.total
FROM m_orders o LEFT JOIN m_totals t ON o.order_id = t.order_id WHERE o.order_status = 'pos'"""
FINALS["closed_orders_on"] = """
SELECT o.order_id, o.location_id, o.customer_id, o.created_ts, t.total
FROM m_orders o LEFT JOIN m_totals t ON o.order_id = t.order_id WHERE CAST(o.order_ts AS DATE) = DATE '1998-10-03'"""
FINALS["sales_by_location"] = """
SELECT l.name AS location_name, CAST(sum(t.subtotal) AS DECIMAL(20,2)) AS subtotal, CAST(sum(t.tax) AS DECIMAL(20,2)) AS tax,
  CAST(sum(t.total) AS DECIMAL(20,2)) AS total
FROM m_orders o JOIN m_totals t ON o.order_id = t.order_id JOIN m_locations l ON o.location_id = l.location_id
WHERE CAST(o.close_ts AS DATE) = DATE '1998-10-03' GROUP BY l.name"""
FINALS["payments_by_class"] = """
SELECT CASE WHEN payment_method_id IN (3, 4) THEN 'Credit/Gift' ELSE 'Cash/Check/CC' END AS type,
  CAST(sum(amount) AS DECIMAL(20,2)) AS total
FROM m_cp WHERE CAST(process_ts AS DATE) = DATE '2024-01-15' GROUP BY 1"""
FINALS["with_grand_total"] = f"""
SELECT *, FALSE AS is_total FROM ({FINALS["sales_by_location"]})
UNION ALL
SELECT NULL, CAST(sum(subtotal) AS DECIMAL(20,2)), CAST(sum(tax) AS DECIMAL(20,2)), CAST(sum(total) AS DECIMAL(20,2)), TRUE
FROM ({FINALS["sales_by_location"]})"""
FINALS["payments_with_grand_total"] = f"""
SELECT *, FALSE AS is_total FROM ({FINALS["payments_by_class"]})
UNION ALL SELECT NULL, CAST(sum(total) AS DECIMAL(20,2)), TRUE FROM ({FINALS["payments_by_class"]})"""
FINALS["order_totals"] = "SELECT * FROM m_totals"
FINALS["order_balance_due"] = """
SELECT order_id, customer_id, CAST(total AS DECIMAL(20,2)) AS total, paid, balance_due FROM m_due"""
FINALS["cash_change"] = """
SELECT order_id, CAST(balance_due - CASE WHEN order_id % 3 = 0 THEN 10 ELSE 0 END AS DECIMAL(20,2)) AS amount,
  CASE WHEN order_id % 3 = 2 THEN CAST(10 AS DECIMAL(20,2)) END AS cash_change
FROM m_due"""
FINALS["split_store_credit"] = """
SELECT order_id, ct_consign_id, cash, requested, balance,
  CAST(CASE WHEN requested < 0 THEN requested ELSE bearable END AS DECIMAL(20,2)) AS amount,
  CAST(balance - requested AS DECIMAL(20,2)) AS end_balance,
  requested >= 0 AND bearable < requested AS insufficient,
  requested >= 0 AND bearable < requested AND NOT cash AS may_overdraw
FROM (
  SELECT a.*, d.requested, CASE WHEN a.balance < 0 THEN 0 ELSE least(a.balance, d.requested) END AS bearable
  FROM m_avail a JOIN (
    SELECT m.order_id, CAST(CASE WHEN m.order_id % 9 = 0 THEN -m.balance_due ELSE m.balance_due END AS DECIMAL(20,2)) AS requested
    FROM m_due m JOIN m_orders o ON m.order_id = o.order_id WHERE o.order_status = 'pos'
  ) d ON a.order_id = d.order_id
)"""
NAMED = """, m_asked AS (
  SELECT d.order_id, CAST(CASE WHEN d.order_id % 9 = 0 THEN -d.balance_due ELSE d.balance_due END AS DECIMAL(20,2)) AS requested,
    CASE WHEN d.order_id % 2 = 0 THEN 25 END AS use_amount,
    CASE WHEN d.customer_id % 4 = 1 THEN CASE d.order_id % 12 WHEN 0 THEN NULL WHEN 11 THEN -1 ELSE d.order_id % 60 + 1 END
      ELSE (SELECT min(c.ct_consign_id) FROM m_consign c WHERE c.customer_id = d.customer_id) END AS ct_consign_id
  FROM m_due d WHERE d.order_id IN (SELECT order_id FROM m_orders WHERE order_status = 'pos')
), m_answer AS (
  SELECT a.*, c.cash, c.vendor_id, c.customer_id,
    coalesce(c.v_held, 0) + coalesce(c.c_held, 0) - coalesce(s.taken, 0) AS balance,
    CASE WHEN a.ct_consign_id IS NULL THEN 'Please enter store credit customer'
      WHEN c.vendor_id IS NULL AND c.customer_id IS NULL THEN 'does not have a credit balance' END AS reason
  FROM m_asked a LEFT JOIN m_side c ON a.ct_consign_id = c.ct_consign_id LEFT JOIN m_store s ON a.order_id = s.order_id
), m_named_new AS (
  SELECT ct_consign_id, (SELECT max(customer_id) FROM m_customers) + row_number() OVER (ORDER BY ct_consign_id) AS customer_id
  FROM (SELECT DISTINCT ct_consign_id FROM m_answer WHERE reason IS NULL AND customer_id IS NULL)
), m_borne AS (
  SELECT a.order_id, a.ct_consign_id, a.cash, a.requested, a.balance, a.use_amount, coalesce(a.customer_id, n.customer_id) AS customer_id,
    CASE WHEN a.requested < 0 THEN a.requested WHEN a.balance < 0 THEN 0 ELSE least(a.balance, a.requested) END AS bears
  FROM m_answer a LEFT JOIN m_named_new n ON a.ct_consign_id = n.ct_consign_id WHERE a.reason IS NULL
)"""
FINALS["named_store_credit"] = f"""{NAMED}
SELECT order_id, ct_consign_id, cash, requested, CAST(balance AS DECIMAL(20,2)) AS balance,
  CAST(CASE WHEN bears >= requested OR use_amount IS NULL THEN bears WHEN cash AND use_amount > bears THEN bears
    ELSE use_amount END AS DECIMAL(20,2)) AS amount,
  CAST(balance - requested AS DECIMAL(20,2)) AS end_balance, bears < requested AS insufficient,
  bears < requested AND NOT cash AS may_overdraw, customer_id
FROM m_borne"""
FINALS["named_store_credit_customers"] = f"{NAMED} SELECT customer_id, ct_consign_id FROM m_named_new"
FINALS["named_store_credit_orders"] = f"""{NAMED}
SELECT o.order_id, coalesce(b.customer_id, o.customer_id) AS customer_id FROM m_orders o
  LEFT JOIN m_borne b ON o.order_id = b.order_id AND (b.bears >= b.requested OR b.use_amount IS NOT NULL)"""
FINALS["named_store_credit_rejected"] = f"{NAMED} SELECT order_id, ct_consign_id, reason FROM m_answer WHERE reason IS NOT NULL"


def _spent(requests: str) -> str:
    """Requests of an account walked through in order; what is left is carried from row to row."""
    bears = "CASE WHEN q.requested < 0 THEN q.requested WHEN {held} - q.taken < 0 THEN 0 ELSE least({held} - q.taken, q.requested) END"
    takes = f"""CAST(CASE WHEN {bears} >= q.requested OR q.use_amount IS NULL THEN {bears}
      WHEN q.cash AND q.use_amount > {bears} THEN {bears} ELSE q.use_amount END AS DECIMAL(20,2))"""
    return f"""{requests}, m_credit_turn AS (
  SELECT q.*, row_number() OVER (PARTITION BY q.ct_consign_id ORDER BY q.request_id, q.order_id, q.requested) AS n FROM m_credit_asks q
), m_drawn AS (
  SELECT q.*, q.opening AS found, {takes.replace('{held}', 'q.opening')} AS amount FROM m_credit_turn q WHERE q.n = 1
  UNION ALL
  SELECT q.*, CAST(d.found - d.amount AS DECIMAL(20,2)), {takes.replace('{held}', '(d.found - d.amount)')}
  FROM m_drawn d JOIN m_credit_turn q ON q.ct_consign_id = d.ct_consign_id AND q.n = d.n + 1
)
SELECT order_id, ct_consign_id, cash, requested, CAST(found - taken AS DECIMAL(20,2)) AS balance, amount,
  CAST(found - amount AS DECIMAL(20,2)) AS left_balance,
  requested >= 0 AND (found - taken < 0 AND requested > 0 OR found - taken < requested) AS insufficient,
  requested >= 0 AND (found - taken < 0 AND requested > 0 OR found - taken < requested) AND NOT cash AS may_overdraw"""


SIDES = """c.cash, CAST(coalesce(c.v_held, 0) + coalesce(c.c_held, 0) AS DECIMAL(20,2)) AS opening,
    CAST(coalesce(s.taken, 0) AS DECIMAL(20,2)) AS taken"""
FINALS["spend_store_credit"] = _spent(f""", m_credit_asks AS (
  SELECT 0 AS request_id, d.order_id, c.ct_consign_id, NULL AS use_amount, {SIDES},
    CAST(CASE WHEN d.order_id % 9 = 0 THEN -d.balance_due ELSE d.balance_due END AS DECIMAL(20,2)) AS requested
  FROM m_due d JOIN m_orders o ON d.order_id = o.order_id JOIN m_side c ON c.customer_id = o.customer_id
    LEFT JOIN m_store s ON s.order_id = d.order_id WHERE o.order_status = 'pos'
)""") + " FROM m_drawn"
FINALS["spend_named_credit"] = _spent(f""", m_open_asks AS (
  SELECT d.order_id, CASE d.order_id % 12 WHEN 0 THEN NULL WHEN 11 THEN -1 ELSE d.order_id % 60 + 1 END AS ct_consign_id,
    CAST(CASE WHEN d.order_id % 9 = 0 THEN -d.balance_due ELSE d.balance_due END AS DECIMAL(20,2)) AS requested,
    CASE WHEN d.order_id % 2 = 0 THEN CAST(25 AS DECIMAL(20,2)) END AS use_amount
  FROM m_due d JOIN m_orders o ON d.order_id = o.order_id WHERE o.order_status = 'pos'
), m_credit_asks AS (
  SELECT q.request_id, q.order_id, q.ct_consign_id, q.use_amount, {SIDES}, q.requested
  FROM (SELECT 2 * order_id AS request_id, * FROM m_open_asks
    UNION ALL SELECT 2 * order_id - 1, order_id, ct_consign_id, 1, use_amount FROM m_open_asks WHERE order_id % 5 = 0) q
  JOIN m_side c ON c.ct_consign_id = q.ct_consign_id LEFT JOIN m_store s ON s.order_id = q.order_id
)""") + ", request_id FROM m_drawn"
FINALS["accumulate_store_credit"] = """
SELECT min(order_payment_id) AS order_payment_id, order_id, payment_method_id, CAST(sum(amount) AS DECIMAL(20,2)) AS amount
FROM m_op WHERE payment_method_id = 3 GROUP BY order_id, payment_method_id
UNION ALL
SELECT order_payment_id, order_id, payment_method_id, amount FROM m_op WHERE payment_method_id <> 3"""
FINALS["merge_duplicate_payments"] = """
SELECT order_id, payment_method_id, CAST(sum(amount) AS DECIMAL(20,2)) AS amount, count(*) AS idcount
FROM m_op WHERE customer_payment_id IS NULL AND payment_method_id IN (2, 3, 4)
GROUP BY order_id, payment_method_id HAVING count(*) > 1"""
FINALS["merge_duplicate_payment_ids"] = """
SELECT order_id, payment_method_id, order_payment_id FROM (
  SELECT *, count(*) OVER (PARTITION BY order_id, payment_method_id) AS n FROM m_op
  WHERE customer_payment_id IS NULL AND payment_method_id IN (2, 3, 4)
) WHERE n > 1"""
FINALS["payments_after_merge"] = "SELECT * FROM m_merged"
FINALS["payments_to_process"] = """
SELECT p.order_payment_id, p.order_id, p.payment_method_id, p.amount, p.gift_card_id, m.payment_processor_id, m.cash, m.till_method
FROM m_op p JOIN m_methods m ON p.payment_method_id = m.payment_method_id WHERE p.customer_payment_id IS NULL"""
FINALS["customer_payments"] = """
SELECT CAST((SELECT max(customer_payment_id) FROM m_cp) + row_number() OVER (ORDER BY p.order_payment_id) AS BIGINT)
    AS customer_payment_id,
  p.order_payment_id, p.order_id, o.customer_id, o.location_id, p.payment_method_id, p.amount,
  m.payment_processor_id, p.gift_card_id, TIMESTAMP '2002-01-01 12:00:00' AS process_ts
FROM m_op p JOIN m_orders o ON p.order_id = o.order_id JOIN m_methods m ON p.payment_method_id = m.payment_method_id
WHERE p.customer_payment_id IS NULL"""
FINALS["invoice_payments"] = f"""
SELECT i.invoice_id, c.amount, 'customer_payment' AS ref, c.customer_payment_id AS ref_id
FROM ({FINALS["customer_payments"]}) c JOIN m_invoices i ON c.order_id = i.order_id"""
FINALS["latest_till"] = """
SELECT l.location_id, t.created_ts, t.till_transaction_id, t.cash_balance, t.location_id IS NULL AS must_balance_first
FROM m_locations l LEFT JOIN (
  SELECT location_id, process_ts AS created_ts, customer_payment_id AS till_transaction_id, amount AS cash_balance
  FROM m_cp WHERE payment_method_id IN (1, 5)
  QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY process_ts DESC, customer_payment_id DESC) = 1
) t ON t.location_id = l.location_id"""
FINALS["till_running_balance"] = """
SELECT location_id, process_ts, customer_payment_id, payment_method_id,
  CAST(100 + sum(CASE WHEN payment_method_id = 1 THEN amount ELSE 0 END) OVER (PARTITION BY location_id
    ORDER BY process_ts, customer_payment_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(20,2)) AS cash_balance
FROM m_cp WHERE payment_method_id IN (1, 5)"""
FINALS["reclass_store_credit_postings"] = """
SELECT p.customer_payment_id, CASE WHEN c.vendor_id IS NOT NULL THEN 'vendor' ELSE 'customer' END AS ref,
  coalesce(c.vendor_id, p.customer_id) AS ref_id, 'cc' AS account, p.amount AS debit, CAST(0 AS DECIMAL(20,2)) AS credit
FROM m_cp p LEFT JOIN m_consign c ON c.customer_id = p.customer_id AND c.cash AND c.vendor_id IS NOT NULL
WHERE p.payment_method_id = 3"""
FINALS["apply_order_discount"] = """
SELECT l.order_id, l.line_number, l.item_id,
  CAST(CASE WHEN d.percent IS NOT NULL AND l.item_id IS NOT NULL THEN l.unit_price * (100 - d.percent) * 0.01
    ELSE l.unit_price END AS DECIMAL(20,2)) AS unit_price,
  CASE WHEN d.percent IS NOT NULL AND l.item_id IS NOT NULL THEN TRUE ELSE l.discounted END AS discounted
FROM m_lines l LEFT JOIN (
  SELECT order_id, CAST(order_id % 50 AS INTEGER) AS percent FROM m_orders WHERE order_status = 'pos' AND discount IS NULL
) d ON l.order_id = d.order_id"""
FINALS["apply_order_discount_orders"] = """
SELECT order_id, CAST(CASE WHEN order_status = 'pos' AND discount IS NULL THEN order_id % 50 ELSE discount END AS INTEGER) AS discount
FROM m_orders"""
FINALS["remove_order_discount_orders"] = """
SELECT order_id, CAST(CASE WHEN order_status = 'closed' THEN discount END AS INTEGER) AS discount FROM m_orders"""
FINALS["remove_order_discount"] = """
SELECT l.order_id, l.line_number, l.item_id,
  CAST(CASE WHEN o.order_id IS NOT NULL AND l.item_id IS NOT NULL
    THEN CAST((CAST(l.unit_price * 1000 AS BIGINT) + 4) // 8 AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(3,2))
    ELSE l.unit_price END AS DECIMAL(20,2)) AS unit_price,
  CASE WHEN o.order_id IS NOT NULL AND l.item_id IS NOT NULL THEN NULL ELSE l.discounted END AS discounted
FROM m_lines l LEFT JOIN m_orders o ON l.order_id = o.order_id AND o.order_status = 'pos' AND o.discount = 20"""
FINALS["toggle_line_discount"] = """
SELECT order_id, line_number, flag,
  CAST(CASE WHEN open_discount AND flag = 'add' AND discounted IS NULL THEN unit_price * CAST(0.8 AS DECIMAL(2,1))
    WHEN open_discount AND flag = 'remove' AND discounted
      THEN CAST((CAST(unit_price * 1000 AS BIGINT) + 4) // 8 AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(3,2))
    ELSE unit_price END AS DECIMAL(20,2)) AS unit_price,
  CASE WHEN open_discount AND flag = 'add' AND discounted IS NULL THEN TRUE
    WHEN open_discount AND flag = 'remove' AND discounted THEN NULL ELSE discounted END AS discounted
FROM (
  SELECT l.*, CASE WHEN l.line_number % 2 = 0 THEN 'add' ELSE 'remove' END AS flag,
    o.order_status = 'pos' AND o.discount IS NOT NULL AS open_discount
  FROM m_lines l JOIN m_orders o ON l.order_id = o.order_id
)"""
FINALS["price_sale_lines"] = """
SELECT order_id, line_number, item_id, 'item' AS item_type, qty,
  CAST(CASE WHEN discount IS NOT NULL THEN price * CAST(0.8 AS DECIMAL(2,1)) ELSE price END AS DECIMAL(20,2)) AS unit_price,
  CASE WHEN discount IS NOT NULL THEN TRUE END AS discounted
FROM (
  SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_number, l.l_suppkey AS item_id, o.discount,
    CASE WHEN l.l_linenumber % 5 = 0 OR l.l_quantity = 0 THEN 1 ELSE CAST(l.l_quantity AS INTEGER) END AS qty,
    CAST(CASE WHEN l.l_linenumber % 3 = 1 AND l.l_extendedprice <> 0 THEN l.l_extendedprice
      WHEN s.s_suppkey % 4 = 0 THEN 0 ELSE s.s_acctbal END AS DECIMAL(20,2)) AS price
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_suppkey % 19 <> 0
    JOIN m_orders o ON o.order_id = l.l_orderkey
)"""
FINALS["reject_invalid_items"] = """
SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_suppkey AS item_id FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 19 <> 0)"""
FINALS["allowed_payment_methods"] = """
SELECT DISTINCT CAST(n.n_nationkey AS BIGINT) AS employee_id, m.payment_method_id, m.name
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN m_methods m ON (m.payment_method_id + r.r_regionkey) % 2 = 0"""
FINALS["allowed_payment_methods_of_one"] = FINALS["allowed_payment_methods"] + " WHERE n.n_nationkey = 3"
FINALS["new_gift_cards"] = """
SELECT request_id, order_id, CAST(gift_card_id AS BIGINT) AS gift_card_id, name, amount FROM m_new_cards"""
FINALS["issue_gift_lines"] = """
SELECT request_id, order_id, 'gift_card' AS item_type, 'GiftCard ' || CAST(gift_card_id AS VARCHAR) AS description,
  CAST(NULL AS BIGINT) AS item_id, 1 AS qty, amount AS unit_price, CAST(gift_card_id AS BIGINT) AS gift_card_id FROM m_new_cards
UNION ALL
SELECT g.request_id, g.order_id, 'gift_card', 'GiftCard', c.item_id, 1, g.amount, NULL
FROM m_gift_req g JOIN m_orders o ON g.order_id = o.order_id JOIN m_consign c ON c.customer_id = o.customer_id
WHERE g.event_type = 'view'
UNION ALL
SELECT request_id, order_id, 'pay_account', 'Account Payment', NULL, 1, amount, NULL FROM m_gift_req WHERE event_type = 'purchase'"""
FINALS["cash_gift_to_account"] = """
SELECT o.order_id, c.customer_id, 'gift_card' AS item_type, CASE WHEN c.customer_id IS NOT NULL THEN c.item_id END AS item_id,
  1 AS qty, b.posted AS unit_price, CAST(4 AS BIGINT) AS payment_method_id, b.posted AS payment_amount, g.gift_card_id
FROM m_orders o JOIN m_consign c ON c.ct_consign_id = o.order_id % 10
  JOIN m_cards g ON g.gift_card_id = o.order_id % 50 * 20
  JOIN m_bal b ON b.ref = 'gift_card' AND b.account = 'gift' AND b.ref_id = g.gift_card_id AND b.posted > 0
WHERE o.order_status = 'pos' AND NOT EXISTS (SELECT 1 FROM m_lines l WHERE l.order_id = o.order_id)"""
GIFTS = """, m_gift_asked AS (
  SELECT o.order_id, c.ct_consign_id, c.customer_id, c.item_id, g.gift_card_id, coalesce(b.posted, 0) AS posted,
    EXISTS (SELECT 1 FROM m_lines l WHERE l.order_id = o.order_id) AS filled, q.ct AS asked_ct, q.card AS asked_card
  FROM (SELECT order_id, order_id % 10 AS ct, order_id % 50 * 20 AS card FROM m_orders WHERE order_status = 'pos') q
    JOIN m_orders o ON o.order_id = q.order_id LEFT JOIN m_consign c ON c.ct_consign_id = q.ct
    LEFT JOIN m_cards g ON g.gift_card_id = q.card
    LEFT JOIN m_bal b ON b.ref = 'gift_card' AND b.account = 'gift' AND b.ref_id = g.gift_card_id
), m_gift_turn AS (
  SELECT *, NOT filled AND ct_consign_id IS NOT NULL AND gift_card_id IS NOT NULL AND posted > 0 AS able,
    row_number() OVER (PARTITION BY asked_card, NOT filled AND ct_consign_id IS NOT NULL AND gift_card_id IS NOT NULL AND posted > 0
      ORDER BY order_id) AS turn
  FROM m_gift_asked
)"""
FINALS["cash_gifts"] = f"""{GIFTS}
SELECT order_id, customer_id, 'gift_card' AS item_type, CASE WHEN customer_id IS NOT NULL THEN item_id END AS item_id,
  1 AS qty, posted AS unit_price, CAST(4 AS BIGINT) AS payment_method_id, posted AS payment_amount, gift_card_id
FROM m_gift_turn WHERE able AND turn = 1"""
FINALS["cash_gifts_rejected"] = f"""{GIFTS}
SELECT order_id, asked_ct AS ct_consign_id, asked_card AS gift_card_id,
  CASE WHEN filled THEN 'order has lines' WHEN ct_consign_id IS NULL THEN 'choose a customer account to apply the balance'
    WHEN gift_card_id IS NULL THEN 'not a valid gift card number' ELSE 'gift card does not have a balance left' END AS reason
FROM m_gift_turn WHERE NOT (able AND turn = 1)"""
FINALS["order_worklist"] = """
SELECT o.order_id, p.order_balance,
  x.has_lines AND p.order_balance <> 0 AS can_pay,
  x.has_payments AND p.order_balance = 0 AS can_close,
  x.has_lines AND o.discount IS NULL AS can_discount,
  o.customer_id <> 1 AND p.gl_credit_balance < 0 AS owes_account,
  NOT x.has_lines AS can_apply_gift
FROM m_orders o JOIN m_position p ON o.order_id = p.order_id
  JOIN (SELECT order_id, order_id IN (SELECT order_id FROM m_lines) AS has_lines,
    order_id IN (SELECT order_id FROM m_op) AS has_payments FROM m_orders) x ON x.order_id = o.order_id
WHERE o.order_status = 'pos'"""
FINALS["close_orders"] = """
SELECT order_id, customer_id, location_id, 'order' AS order_type, 'closed' AS order_status,
  coalesce(order_ts, TIMESTAMP '2002-01-01 12:00:00') AS order_ts, coalesce(close_ts, TIMESTAMP '2002-01-01 12:00:00') AS close_ts
FROM m_orders"""
FINALS["reassign_customer"] = """
SELECT order_id, CASE WHEN order_status = 'pos' AND order_id % 3 = 0 THEN customer_id + 1 ELSE customer_id END AS customer_id
FROM m_orders"""
FINALS["reassign_customer_payments"] = """
SELECT p.order_payment_id, p.order_id, p.payment_method_id, p.amount FROM m_op p
WHERE NOT (p.payment_method_id = 3 AND p.order_id IN (
  SELECT order_id FROM m_orders WHERE order_status = 'pos' AND order_id % 3 = 0 AND customer_id <> 1))"""
FINALS["drop_orders"] = "SELECT order_id, customer_id FROM m_orders WHERE order_status <> 'pos'"
FINALS["drop_orders_lines"] = """
SELECT order_id, line_number, item_id, total_price FROM m_lines
WHERE order_id NOT IN (SELECT order_id FROM m_orders WHERE order_status = 'pos')"""
FINALS["drop_orders_payments"] = """
SELECT order_payment_id, order_id, amount FROM m_op
WHERE order_id NOT IN (SELECT order_id FROM m_orders WHERE order_status = 'pos')"""
FINALS["drop_orders_shipping"] = """
SELECT o.order_id, CAST(0 AS DECIMAL(10,2)) AS cost, l.state, l.zipcode
FROM m_orders o JOIN m_locations l ON o.location_id = l.location_id WHERE o.order_status <> 'pos'"""
FINALS["remove_lines"] = """
SELECT order_id, line_number, item_id, total_price FROM m_lines
WHERE NOT (line_number = 1 AND order_id IN (SELECT order_id FROM m_orders WHERE order_status = 'pos'))"""
FINALS["remove_unprocessed_payments"] = """
SELECT order_payment_id, order_id, payment_method_id, amount FROM m_op
WHERE payment_method_id <> 2 OR customer_payment_id IS NOT NULL"""

# Repairs

FINALS["name_drift"] = """
SELECT 'vendor' AS ref, v.vendor_id AS ref_id, v.name AS old_name, c.name AS new_name
FROM m_vendors v JOIN m_consign c ON v.vendor_id = c.vendor_id WHERE v.name <> c.name
UNION ALL
SELECT 'customer', k.customer_id, k.company, c.name
FROM m_customers k JOIN m_consign c ON k.customer_id = c.customer_id WHERE k.company <> c.name"""
FINALS["name_drift_fixed_vendors"] = "SELECT vendor_id, name FROM m_consign WHERE vendor_id IS NOT NULL"
FINALS["propagate_name_changes"] = """
SELECT 'vendor' AS ref, vendor_id AS ref_id, name AS new_name FROM m_edited WHERE ct_consign_id % 5 = 0 AND vendor_id IS NOT NULL
UNION ALL
SELECT 'customer', customer_id, name FROM m_edited WHERE ct_consign_id % 5 = 0 AND customer_id IS NOT NULL"""
FINALS["payment_date_repair_set"] = "SELECT * FROM m_repair"
FINALS["apply_dates"] = """
SELECT o.order_id, coalesce(r.d, o.created_ts) AS created_ts, coalesce(r.d, o.order_ts) AS order_ts,
  coalesce(r.d, o.close_ts) AS close_ts
FROM m_orders o LEFT JOIN (SELECT order_id, min(payment_date) AS d FROM m_repair GROUP BY order_id) r ON o.order_id = r.order_id"""
FINALS["apply_dates_invoices"] = """
SELECT i.invoice_id, coalesce((SELECT min(r.payment_date) FROM m_repair r WHERE r.invoice_id = i.invoice_id), i.created_ts)
  AS created_ts FROM m_invoices i"""
FINALS["apply_dates_payments"] = """
SELECT p.customer_payment_id,
  coalesce((SELECT min(r.payment_date) FROM m_repair r WHERE r.customer_payment_id = p.customer_payment_id), p.process_ts)
  AS process_ts FROM m_cp p"""
FINALS["apply_dates_deposits"] = """
SELECT o.deposit_id, coalesce(r.d, o.deposit_date) AS deposit_date, o.amount
FROM m_deposits o LEFT JOIN (SELECT deposit_id, min(payment_date) AS d FROM m_repair GROUP BY deposit_id) r
  ON o.deposit_id = r.deposit_id"""
FINALS["misfiled_balances"] = """
SELECT ct_consign_id, cash, v_held AS cash_balance, c_held AS credit_balance, consign_percent, vendor_id, customer_id
FROM m_side WHERE v_held IS NOT NULL AND c_held IS NOT NULL
  AND NOT (v_held = 0 AND c_held = 0) AND NOT (v_held = 0 AND NOT cash) AND NOT (c_held = 0 AND cash)"""
FINALS["misfiled_corrections"] = f"""
SELECT 'ct_consign' AS trans_ref, ct_consign_id AS trans_ref_id, 'Cash/Credit Adjustment' AS description, e.ref,
  CASE WHEN e.ref = 'vendor' THEN vendor_id ELSE customer_id END AS ref_id, 'cc' AS account,
  CASE WHEN cash = (e.ref = 'customer') THEN moved ELSE 0 END AS debit,
  CASE WHEN cash = (e.ref = 'vendor') THEN moved ELSE 0 END AS credit
FROM (SELECT *, CASE WHEN cash THEN credit_balance ELSE cash_balance END AS moved FROM ({FINALS["misfiled_balances"]})) x,
  (VALUES ('vendor'), ('customer')) e(ref)"""
FINALS["ar_reversal"] = """
SELECT 'invoice' AS trans_ref, trans_ref_id, post_date AS ref_date, 'Initial Setup' AS description, ref, ref_id, a.account,
  CASE WHEN a.account = 'earn' THEN debit ELSE 0 END AS debit, CASE WHEN a.account = 'ar' THEN debit ELSE 0 END AS credit
FROM m_post, (VALUES ('ar'), ('earn')) a(account)
WHERE trans_ref = 'invoice' AND m_post.account = 'ar' AND post_date IS NOT NULL"""
FINALS["ar_reversal_of_day"] = FINALS["ar_reversal"] + """
  AND trans_ref_id IN (SELECT invoice_id FROM m_invoices WHERE CAST(created_ts AS DATE) = DATE '1998-10-03')"""
FINALS["backfill_customers"] = """
SELECT ct_consign_id, vendor_id, CAST(customer_id AS BIGINT) AS customer_id FROM m_filled"""
FINALS["opening_balances"] = """
SELECT 'ct_consign' AS trans_ref, ct_consign_id AS trans_ref_id, 'Initial Balance' AS description, ref, ref_id, a.account,
  CASE WHEN a.account = 'earn' THEN amount ELSE 0 END AS debit, CASE WHEN a.account = 'cc' THEN amount ELSE 0 END AS credit
FROM m_opening, (VALUES ('cc'), ('earn')) a(account)"""
FINALS["gift_opening"] = """
SELECT 'gift_card' AS trans_ref, CAST(new_id AS BIGINT) AS trans_ref_id, 'Gift Card Import' AS description, name AS memo,
  'gift_card' AS ref, CAST(new_id AS BIGINT) AS ref_id, a.account,
  CAST(CASE WHEN a.account = 'earn' THEN balance ELSE 0 END AS DECIMAL(20,2)) AS debit,
  CAST(CASE WHEN a.account = 'gift' THEN balance ELSE 0 END AS DECIMAL(20,2)) AS credit
FROM (SELECT *, (SELECT max(gift_card_id) FROM m_cards) + row_number() OVER (ORDER BY legacy_code) AS new_id FROM m_cards) x,
  (VALUES ('gift'), ('earn')) a(account)"""
FINALS["purge_by_ref"] = "SELECT trans_id, ref, ref_id FROM m_trans WHERE ref <> 'deposit'"
FINALS["purge_by_ref_postings"] = """
SELECT trans_id, ref, ref_id, account, debit, credit FROM m_post WHERE trans_ref <> 'deposit'"""
FINALS["purge_by_ref_links"] = "SELECT customer_payment_id, CAST(NULL AS BIGINT) AS deposit_id FROM m_cp"
FINALS["change_log"] = """
SELECT * FROM (
  SELECT a.ct_consign_id, f.field, f.field || ' changed from ' || f.old_value || ' to ' || f.new_value AS message
  FROM m_consign a JOIN m_edited b ON a.ct_consign_id = b.ct_consign_id, LATERAL (
    SELECT 'name' AS field, a.name AS old_value, b.name AS new_value
    UNION ALL SELECT 'cash', CAST(a.cash AS VARCHAR), CAST(b.cash AS VARCHAR)
    UNION ALL SELECT 'consign_percent', CAST(a.consign_percent AS VARCHAR), CAST(b.consign_percent AS VARCHAR)
    UNION ALL SELECT 'consign_fee', coalesce(CAST(a.consign_fee AS VARCHAR), ''), coalesce(CAST(b.consign_fee AS VARCHAR), '')
  ) f WHERE f.old_value <> f.new_value
)"""
FINALS["account_activity"] = """
SELECT CASE WHEN event_type = 'error' THEN 'note' ELSE 'log' END AS kind, user_id % 100 AS ct_consign_id, ts AS created_ts,
  props AS message FROM events WHERE event_id % 4 <> 0"""

FINALS["recent_activity"] = """
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY ct_consign_id, kind ORDER BY created_ts DESC, entry_id DESC) AS INTEGER) AS place FROM (
    SELECT user_id % 100 AS ct_consign_id, CASE WHEN event_type = 'error' THEN 'note' ELSE 'log' END AS kind, event_id AS entry_id,
      ts AS created_ts, props AS message
    FROM events WHERE event_id % 4 <> 0)
) WHERE place <= 10"""

# Text, keys, validation

FINALS["search_consignors"] = """
SELECT ct_consign_id, name, customer_id, vendor_id FROM m_consign WHERE lower(name) SIMILAR TO '.*supplier#0000000(01|02).*'"""
FINALS["search_consignors_by_id"] = "SELECT ct_consign_id, name, customer_id, vendor_id FROM m_consign WHERE ct_consign_id = 7"
FINALS["search_json"] = """
SELECT ct_consign_id, '{"ct_consign_id":"' || CAST(ct_consign_id AS VARCHAR) || '","name":"' || replace(name, '"', '') || '"}' AS json
FROM m_consign WHERE regexp_matches(name, 'supplier#0000000(01|02)', 'i')"""
FINALS["legal_name"] = """
SELECT request_id, name, CASE WHEN request_id % 5 > 1 THEN split_part(name, ', ', 2) || ' ' || split_part(name, ', ', 1) END AS legal_name
FROM m_requests"""
FINALS["next_ids"] = """
SELECT order_payment_id, CAST((SELECT max(order_id) FROM m_orders) + row_number() OVER (ORDER BY order_payment_id) AS BIGINT)
  AS order_id FROM m_op"""
FINALS["reserved_ids"] = """
SELECT order_payment_id, CAST((SELECT max(order_id) FROM m_orders) + 1000 + row_number() OVER (ORDER BY order_payment_id) AS BIGINT)
  AS order_id FROM m_op"""
FINALS["validate_new_accounts"] = "SELECT request_id, name, cash, consign_percent, consign_fee, missing FROM m_valid"
FINALS["reject_invalid_discounts"] = """
SELECT * FROM (
  SELECT order_id AS request_id, order_id, CASE order_id % 4 WHEN 0 THEN '15' WHEN 1 THEN '100' WHEN 2 THEN 'abc' END AS percent,
    CASE WHEN close_ts IS NOT NULL THEN 'order is closed' WHEN discount IS NOT NULL THEN 'order is already discounted'
      WHEN order_id % 4 <> 0 THEN 'not a valid discount' END AS reason
  FROM m_orders
) WHERE reason IS NOT NULL"""
FINALS["create_accounts"] = """
SELECT request_id, ct_consign_id, name, cash, consign_percent, consign_fee, item_id, CAST(vendor_id AS BIGINT) AS vendor_id,
  CAST(customer_id AS BIGINT) AS customer_id FROM m_accounts"""
FINALS["create_accounts_rejected"] = """
SELECT request_id, ct_consign_id, reason FROM m_taken WHERE reason IS NOT NULL"""
FINALS["create_accounts_vendors"] = """
SELECT CAST(vendor_id AS BIGINT) AS vendor_id, name, CAST(ct_consign_id AS VARCHAR) AS account,
  CASE WHEN request_id % 5 > 1 THEN split_part(name, ', ', 2) || ' ' || split_part(name, ', ', 1) END AS legal_name
FROM m_accounts WHERE cash"""

# Whole journeys. Closing bills the orders still at the till, so their invoices replace the stored ones.

_PAYMENTS = PRELUDE[PRELUDE.index("m_op AS (") : PRELUDE.index("m_deposits AS (")]
_NEW_INVOICES = _PAYMENTS + """m_refused AS (
  SELECT DISTINCT o.order_id, o.location_id FROM m_op p JOIN m_orders o ON p.order_id = o.order_id
  WHERE p.customer_payment_id IS NULL AND p.payment_method_id IN (1, 5) AND o.order_status = 'pos'
    AND o.location_id NOT IN (SELECT location_id FROM m_cp WHERE payment_method_id IN (1, 5))
),
m_invoices AS (
  SELECT (SELECT max(order_id) FROM m_orders WHERE order_status = 'closed')
    + CAST(row_number() OVER (ORDER BY order_id) AS BIGINT) AS invoice_id,
    order_id, customer_id, TIMESTAMP '2002-01-01 12:00:00' AS created_ts FROM m_orders
  WHERE order_status = 'pos' AND order_id NOT IN (SELECT order_id FROM m_refused)
)"""
_START, _END = PRELUDE.index("m_invoices AS ("), PRELUDE.index("m_raw AS (")
CLOSING = PRELUDE[:_START] + _NEW_INVOICES + ",\n" + PRELUDE[_END:].replace(_PAYMENTS, "")
_PAID = """(
  SELECT (SELECT max(customer_payment_id) FROM m_cp) + CAST(row_number() OVER (ORDER BY m.order_payment_id) AS BIGINT) AS id,
    m.*, o.customer_id, o.location_id
  FROM m_merged m JOIN m_orders o ON m.order_id = o.order_id
  WHERE m.customer_payment_id IS NULL AND o.order_status = 'pos' AND o.order_id NOT IN (SELECT order_id FROM m_refused))"""
_CLOSING_FINALS = {
    "close_sales_postings": f"""
SELECT 'invoice' AS trans_ref, invoice_id AS trans_ref_id, {POSTED_LINES} FROM m_inv
UNION ALL SELECT 'customer_payment', id, 'customer', customer_id, 'ar', 0, amount FROM {_PAID}
UNION ALL
SELECT 'customer_payment', p.id,
  CASE p.payment_method_id WHEN 3 THEN CASE WHEN c.vendor_id IS NULL THEN 'customer' ELSE 'vendor' END WHEN 4 THEN 'gift_card' END,
  CASE p.payment_method_id WHEN 3 THEN coalesce(c.vendor_id, p.customer_id) WHEN 4 THEN p.gift_card_id END,
  CASE p.payment_method_id WHEN 3 THEN 'cc' WHEN 4 THEN 'gift' ELSE 'cash' END, p.amount, 0
FROM {_PAID} p LEFT JOIN m_consign c ON c.customer_id = p.customer_id AND c.cash AND c.vendor_id IS NOT NULL""",
    "close_sales_tills": f"""
SELECT (SELECT max(customer_payment_id) FROM m_cp WHERE payment_method_id IN (1, 5))
    + CAST(row_number() OVER (ORDER BY p.id) AS BIGINT) AS till_transaction_id, p.location_id, p.id AS customer_payment_id, p.payment_method_id,
  CAST(t.cash_balance + sum(CASE WHEN p.payment_method_id = 1 THEN p.amount ELSE 0 END)
    OVER (PARTITION BY p.location_id ORDER BY p.id ROWS UNBOUNDED PRECEDING) AS DECIMAL(20,2)) AS cash_balance
FROM {_PAID} p JOIN ({FINALS["latest_till"]}) t ON t.location_id = p.location_id AND NOT t.must_balance_first
WHERE p.payment_method_id IN (1, 5)""",
    "close_sales_payments": f"""
SELECT p.id AS customer_payment_id, p.order_payment_id, p.customer_id, p.payment_method_id, p.amount, m.payment_processor_id,
  p.gift_card_id, CASE WHEN p.payment_method_id IN (1, 5) THEN (SELECT max(customer_payment_id) FROM m_cp WHERE payment_method_id IN (1, 5))
    + CAST(row_number() OVER (PARTITION BY p.payment_method_id IN (1, 5) ORDER BY p.id) AS BIGINT) END AS till_transaction_id
FROM {_PAID} p JOIN m_methods m ON p.payment_method_id = m.payment_method_id""",
    "close_sales_order_payments": f"""
SELECT m.order_payment_id, m.order_id, m.amount, coalesce(m.customer_payment_id, p.id) AS customer_payment_id
FROM m_merged m JOIN m_orders o ON m.order_id = o.order_id LEFT JOIN {_PAID} p ON p.order_payment_id = m.order_payment_id
WHERE o.order_status = 'pos' AND o.order_id NOT IN (SELECT order_id FROM m_refused)""",
    "close_sales_rejected": "SELECT order_id, location_id, 'Need to balance till first' AS reason FROM m_refused",
    "close_sales_orders": """
SELECT order_id, CASE WHEN order_id IN (SELECT order_id FROM m_refused) THEN order_status ELSE 'closed' END AS order_status,
  CASE WHEN order_id IN (SELECT order_id FROM m_refused) THEN close_ts
    ELSE coalesce(close_ts, TIMESTAMP '2002-01-01 12:00:00') END AS close_ts
FROM m_orders""",
}

# Streams, by their batch meaning

FINALS["stream_daily_payments"] = """
SELECT CAST(process_ts AS DATE) AS day, CASE WHEN payment_method_id IN (3, 4) THEN 'Credit/Gift' ELSE 'Cash/Check/CC' END AS type,
  CAST(sum(amount) AS DECIMAL(20,2)) AS total FROM m_cp GROUP BY 1, 2"""
FINALS["stream_daily_sums"] = FINALS["stream_daily_payments"]
FINALS["stream_name_sync"] = FINALS["propagate_name_changes"]
FINALS["stream_till_balance"] = FINALS["till_running_balance"]

FINALS["edit_accounts_log"] = FINALS["edit_accounts_log"].replace("{changes}", FINALS["change_log"])

RECURSIVE = PRELUDE.replace("WITH ", "WITH RECURSIVE ", 1)
STATEMENTS = {name: (RECURSIVE if "m_drawn" in final else PRELUDE) + final for name, final in FINALS.items()} | {
    name: CLOSING + final for name, final in _CLOSING_FINALS.items()
}
