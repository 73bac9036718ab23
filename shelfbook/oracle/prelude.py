"""The shop's tables as ANSI SQL common table expressions over the test tables."""

PRELUDE = """
WITH m_consign AS (
  SELECT s_suppkey AS ct_consign_id, s_suppkey AS item_id, s_name AS name,
    s_suppkey % 3 <> 0 AS cash,
    CASE WHEN s_suppkey % 3 <> 0 OR s_suppkey % 6 = 0 THEN 100000 + s_suppkey END AS vendor_id,
    CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 4 = 2 THEN s_suppkey END AS customer_id,
    CAST(0.3125 + 0.0333 * (s_suppkey % 5) AS DECIMAL(5,4)) AS consign_percent,
    CASE WHEN s_suppkey % 10 = 0 THEN CAST(5 AS DECIMAL(10,2)) END AS consign_fee,
    CASE WHEN s_suppkey % 17 = 0 THEN TIMESTAMP '1998-01-01' END AS inactive_ts
  FROM supplier
),
m_edited AS (
  SELECT ct_consign_id, vendor_id, customer_id,
    CASE WHEN ct_consign_id % 5 = 0 THEN name || ' Jr' ELSE name END AS name,
    CASE WHEN ct_consign_id % 7 = 0 THEN NOT cash ELSE cash END AS cash,
    CASE WHEN ct_consign_id % 11 = 0 THEN CAST(consign_percent + 0.01 AS DECIMAL(5,4)) ELSE consign_percent END
      AS consign_percent,
    CASE WHEN ct_consign_id % 13 = 0 THEN CAST(2.5 AS DECIMAL(10,2)) ELSE consign_fee END AS consign_fee
  FROM m_consign
),
m_vendors AS (
  SELECT vendor_id, CASE WHEN ct_consign_id % 7 = 0 THEN 'Old ' || name ELSE name END AS name
  FROM m_consign WHERE vendor_id IS NOT NULL
),
m_customers AS (
  SELECT c_custkey AS customer_id, c_name AS company, c_custkey = 1 AS cash FROM customer
),
m_locations AS (
  SELECT CAST(n_nationkey AS BIGINT) AS location_id, n_name AS name, n_name AS state,
    lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS zipcode, CAST(100 AS DECIMAL(20,2)) AS opening_balance
  FROM nation
),
m_methods(payment_method_id, name, cash, till_method, store_credit, gift_card, payment_processor_id) AS (
  VALUES (CAST(1 AS BIGINT), 'Cash', TRUE, TRUE, FALSE, FALSE, CAST(NULL AS BIGINT)),
    (2, 'Card', FALSE, NULL, FALSE, FALSE, 9),
    (3, 'Store Credit', FALSE, NULL, TRUE, FALSE, NULL),
    (4, 'Gift Card', FALSE, NULL, FALSE, TRUE, NULL),
    (5, 'Check', FALSE, TRUE, FALSE, FALSE, NULL)
),
m_orders AS (
  SELECT o_orderkey AS order_id, 'order' AS order_type,
    CASE WHEN o_orderstatus = 'O' THEN 'pos' ELSE 'closed' END AS order_status,
    o_custkey AS customer_id, o_orderkey % 25 AS location_id, o_orderdate AS created_ts,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS order_ts,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS close_ts,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 20 END AS discount
  FROM orders
),
m_invoices AS (
  SELECT order_id AS invoice_id, order_id, customer_id, created_ts FROM m_orders WHERE order_status = 'closed'
),
m_raw AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey, l_suppkey, l_partkey % 20 AS kind,
    CAST(l_quantity AS INTEGER) AS qty, CAST(l_extendedprice AS DECIMAL(10,2)) AS unit_price,
    CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(l_quantity AS DECIMAL(6,0)) AS DECIMAL(20,2)) AS total_price,
    CAST(l_tax AS DECIMAL(4,2)) AS tax_rate, l_discount
  FROM lineitem
),
m_lines AS (
  SELECT order_id, line_number,
    CASE kind WHEN 0 THEN 'gift_card' WHEN 1 THEN 'pay_account' ELSE 'item' END AS item_type,
    CASE WHEN kind IN (1, 2) THEN NULL WHEN kind = 0 AND l_suppkey % 2 = 1 THEN NULL ELSE l_suppkey END AS item_id,
    CASE WHEN kind = 0 AND l_suppkey % 2 = 1 AND line_number % 2 = 0 THEN l_partkey END AS gift_card_id,
    qty, unit_price, total_price,
    CAST(total_price * tax_rate AS DECIMAL(20,2)) AS tax_amount,
    CASE WHEN l_discount >= 0.05 THEN TRUE END AS discounted,
    kind = 3 AS manual_sale
  FROM m_raw
),
m_op AS (
  SELECT event_id AS order_payment_id, event_id // 3 AS order_id,
    CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'signup' THEN 4
      ELSE 5 END AS BIGINT) AS payment_method_id,
    CAST(value AS DECIMAL(20,2)) AS amount,
    CASE WHEN (event_id // 30) % 5 <> 0 THEN event_id END AS customer_payment_id,
    CASE WHEN event_type = 'signup' THEN 20 * (event_id % 100) END AS gift_card_id,
    CASE WHEN event_type = 'click' THEN event_id // 50 END AS deposit_id,
    user_id AS customer_id, user_id % 25 AS location_id, ts AS process_ts
  FROM events
),
m_cp AS (SELECT * FROM m_op WHERE customer_payment_id IS NOT NULL),
m_deposits AS (
  SELECT deposit_id, min(process_ts) AS deposit_date, CAST(sum(amount) AS DECIMAL(20,2)) AS amount
  FROM m_cp WHERE deposit_id IS NOT NULL GROUP BY deposit_id
),
m_cards AS (
  SELECT p_partkey AS gift_card_id, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS legacy_code, p_name AS name,
    CAST(p_retailprice AS DECIMAL(10,2)) AS amount,
    CAST(CASE WHEN p_partkey % 60 = 0 THEN 0 ELSE p_retailprice END AS DECIMAL(10,2)) AS balance
  FROM part WHERE p_partkey % 20 = 0
),
m_checks AS (
  SELECT o_orderkey AS check_id, o_orderkey + 5000 AS check_num, 100000 + o_custkey % 10 AS vendor_id,
    CAST(o_totalprice AS DECIMAL(20,2)) AS amount, CASE WHEN o_orderpriority = '5-LOW' THEN TRUE END AS cleared,
    CAST(o_orderdate AS DATE) AS check_date
  FROM orders WHERE o_orderstatus = 'P'
),
m_vouchers AS (
  SELECT 2 * check_id AS voucher_id, check_id, vendor_id, amount, check_date FROM m_checks
  UNION ALL
  SELECT 2 * check_id + 1, check_id, vendor_id, amount, check_date FROM m_checks WHERE check_id % 4 = 0
),
m_docs AS (
  SELECT 'invoice' AS ref, invoice_id AS ref_id, 1 AS kind, CAST(created_ts AS DATE) AS ref_date FROM m_invoices
  UNION ALL SELECT 'customer_payment', customer_payment_id, 2, CAST(process_ts AS DATE) FROM m_cp
  UNION ALL SELECT 'ct_consign', ct_consign_id, 3, DATE '1995-01-01' FROM m_consign
  UNION ALL SELECT 'check', check_id, 4, check_date FROM m_checks WHERE check_id % 9 <> 0
  UNION ALL SELECT 'check', check_id, 8, check_date FROM m_checks WHERE check_id % 9 <> 0 AND check_id % 5 = 0
  UNION ALL SELECT 'ct_consign', ct_consign_id, 5, DATE '1995-01-01' FROM m_consign
  UNION ALL SELECT 'voucher', voucher_id, 7, check_date FROM m_vouchers
  UNION ALL SELECT 'deposit', deposit_id, 9, CAST(deposit_date AS DATE) FROM m_deposits
),
m_trans AS (
  SELECT ref_id * 10 + kind AS trans_id, ref, ref_id, ref_date,
    CASE WHEN ref_id % 11 = 0 THEN NULL ELSE ref_date END AS post_date
  FROM m_docs
),
m_billed AS (
  SELECT l.*, i.invoice_id, i.customer_id AS invoice_customer, CAST(i.created_ts AS DATE) AS ref_date
  FROM m_lines l JOIN m_invoices i ON l.order_id = i.order_id
),
m_share AS (
  SELECT b.invoice_id, b.ref_date, CASE WHEN c.cash THEN 'vendor' ELSE 'customer' END AS ref,
    CASE WHEN c.cash THEN c.vendor_id ELSE c.customer_id END AS ref_id,
    CAST(CASE WHEN c.consign_fee IS NULL
      THEN CAST(sum(b.total_price) AS DECIMAL(24,2)) * c.consign_percent
      ELSE sum(b.qty * (b.unit_price - c.consign_fee)) END AS DECIMAL(20,2)) AS amount
  FROM m_billed b JOIN m_consign c ON b.item_id = c.item_id
  WHERE b.item_type <> 'gift_card'
  GROUP BY b.invoice_id, b.ref_date, c.cash, c.vendor_id, c.customer_id, c.consign_percent, c.consign_fee
),
m_revenue AS (
  SELECT g.invoice_id, g.ref_date,
    CASE WHEN g.item_id IS NULL THEN
        CASE WHEN g.item_type <> 'gift_card' THEN 'customer' WHEN g.gift_card_id IS NULL THEN 'invoice'
          ELSE 'gift_card' END
      WHEN g.item_type = 'gift_card' THEN 'customer' ELSE 'item' END AS ref,
    CASE WHEN g.item_id IS NULL THEN
        CASE WHEN g.item_type <> 'gift_card' THEN g.invoice_customer
          ELSE coalesce(g.gift_card_id, g.invoice_id) END
      WHEN g.item_type = 'gift_card' THEN c.customer_id ELSE g.item_id END AS ref_id,
    CASE WHEN g.item_type = 'gift_card' AND g.item_id IS NULL THEN 'gift'
      WHEN g.item_type = 'gift_card' OR (g.item_type = 'pay_account' AND g.item_id IS NULL) THEN 'cc'
      ELSE 'sales' END AS account,
    g.amount
  FROM (
    SELECT invoice_id, ref_date, invoice_customer, item_id, item_type, gift_card_id,
      CAST(sum(total_price) AS DECIMAL(20,2)) AS amount
    FROM m_billed GROUP BY ALL
  ) g LEFT JOIN m_consign c ON g.item_id = c.item_id
),
m_whole AS (
  SELECT invoice_id, ref_date, invoice_customer, CAST(sum(tax_amount) AS DECIMAL(20,2)) AS tax,
    CAST(sum(total_price) + coalesce(sum(tax_amount), 0) AS DECIMAL(20,2)) AS amount
  FROM m_billed GROUP BY ALL
),
m_inv AS (
  SELECT invoice_id, ref_date, ref, ref_id, account, CAST(0 AS DECIMAL(20,2)) AS debit, amount AS credit FROM m_revenue
  UNION ALL SELECT invoice_id, ref_date, NULL, NULL, 'tax', 0, tax FROM m_whole WHERE tax <> 0
  UNION ALL SELECT invoice_id, ref_date, 'customer', invoice_customer, 'ar', amount, 0 FROM m_whole
  UNION ALL SELECT invoice_id, ref_date, ref, ref_id, 'cc', 0, amount FROM m_share
  UNION ALL SELECT invoice_id, ref_date, ref, ref_id, 'cogs', amount, 0 FROM m_share
),
m_pay AS (
  SELECT customer_payment_id, CAST(process_ts AS DATE) AS ref_date, 'customer' AS ref, customer_id AS ref_id,
    'ar' AS account, CAST(0 AS DECIMAL(20,2)) AS debit, amount AS credit FROM m_cp
  UNION ALL
  SELECT customer_payment_id, CAST(process_ts AS DATE),
    CASE payment_method_id WHEN 3 THEN 'customer' WHEN 4 THEN 'gift_card' END,
    CASE payment_method_id WHEN 3 THEN customer_id WHEN 4 THEN gift_card_id END,
    CASE payment_method_id WHEN 3 THEN 'cc' WHEN 4 THEN 'gift' ELSE 'cash' END, amount, 0 FROM m_cp
),
m_opening AS (
  SELECT c.ct_consign_id, CASE WHEN c.cash THEN 'vendor' ELSE 'customer' END AS ref,
    CASE WHEN c.cash THEN c.vendor_id ELSE c.customer_id END AS ref_id,
    CAST(s.s_acctbal AS DECIMAL(20,2)) AS amount
  FROM m_consign c JOIN supplier s ON c.ct_consign_id = s.s_suppkey WHERE s.s_acctbal <> 0
),
m_book AS (
  SELECT 'invoice' AS trans_ref, invoice_id AS trans_ref_id, 1 AS kind, ref_date, ref, ref_id, account, debit, credit FROM m_inv
  UNION ALL SELECT 'customer_payment', customer_payment_id, 2, ref_date, ref, ref_id, account, debit, credit FROM m_pay
  UNION ALL SELECT 'ct_consign', ct_consign_id, 3, DATE '1995-01-01', ref, ref_id, 'cc', 0, amount FROM m_opening
  UNION ALL SELECT 'ct_consign', ct_consign_id, 3, DATE '1995-01-01', ref, ref_id, 'earn', amount, 0 FROM m_opening
  UNION ALL SELECT 'ct_consign', ct_consign_id, 5, DATE '1995-01-01', 'customer', customer_id, 'cc', 100000000, 0
    FROM m_consign WHERE cash AND customer_id IS NOT NULL AND ct_consign_id % 8 = 2
  UNION ALL SELECT 'ct_consign', ct_consign_id, 5, DATE '1995-01-01', 'vendor', vendor_id, 'cc', 0,
      CASE WHEN ct_consign_id % 12 = 0 THEN 50 ELSE 0 END
    FROM m_consign WHERE NOT cash AND ct_consign_id % 6 = 0
  UNION ALL SELECT 'voucher', voucher_id, 7, check_date, 'vendor', vendor_id, 'earn', amount, 0 FROM m_vouchers
  UNION ALL SELECT 'voucher', voucher_id, 7, check_date, 'vendor', vendor_id, 'ap', 0, amount FROM m_vouchers
  UNION ALL SELECT 'check', check_id, 4, check_date, 'vendor', vendor_id, 'ap', amount, 0 FROM m_checks WHERE cleared AND check_id % 9 <> 0
  UNION ALL SELECT 'check', check_id, 4, check_date, NULL, NULL, 'bank', 0, amount FROM m_checks WHERE cleared AND check_id % 9 <> 0
  UNION ALL SELECT 'deposit', deposit_id, 9, CAST(deposit_date AS DATE), NULL, NULL, 'bank', amount, 0 FROM m_deposits
  UNION ALL SELECT 'deposit', deposit_id, 9, CAST(deposit_date AS DATE), NULL, NULL, 'cash', 0, amount FROM m_deposits
),
m_post AS (
  SELECT trans_ref_id * 10 + kind AS trans_id, trans_ref, trans_ref_id,
    CASE WHEN trans_ref_id % 11 <> 0 THEN ref_date END AS post_date, ref, CAST(ref_id AS BIGINT) AS ref_id, account,
    CAST(debit AS DECIMAL(20,2)) AS debit, CAST(credit AS DECIMAL(20,2)) AS credit
  FROM m_book
),
m_bal AS (
  SELECT ref, ref_id, account, CAST(sum(credit - debit) AS DECIMAL(20,2)) AS held,
    CAST(sum(credit - debit) FILTER (WHERE post_date IS NOT NULL) AS DECIMAL(20,2)) AS posted,
    CAST(sum(credit - debit) FILTER (WHERE post_date < DATE '1999-01-01') AS DECIMAL(20,2)) AS early
  FROM m_post WHERE ref IS NOT NULL GROUP BY ref, ref_id, account
),
m_side AS (
  SELECT c.*, v.held AS v_held, v.posted AS v_posted, v.early AS v_early,
    k.held AS c_held, k.posted AS c_posted, k.early AS c_early
  FROM m_consign c
    LEFT JOIN m_bal v ON v.ref = 'vendor' AND v.account = 'cc' AND v.ref_id = c.vendor_id
    LEFT JOIN m_bal k ON k.ref = 'customer' AND k.account = 'cc' AND k.ref_id = c.customer_id
),
m_totals AS (
  SELECT order_id, CAST(sum(total_price) AS DECIMAL(20,2)) AS subtotal,
    CAST(coalesce(sum(tax_amount), 0) AS DECIMAL(20,2)) AS tax,
    CAST(sum(total_price) + coalesce(sum(tax_amount), 0) AS DECIMAL(20,2)) AS total
  FROM m_lines GROUP BY order_id
),
m_due AS (
  SELECT o.order_id, o.customer_id, coalesce(t.total, 0) AS total,
    CAST(coalesce((SELECT sum(p.amount) FROM m_op p WHERE p.order_id = o.order_id), 0) AS DECIMAL(20,2)) AS paid,
    CAST(coalesce(t.total, 0) - coalesce((SELECT sum(p.amount) FROM m_op p WHERE p.order_id = o.order_id), 0)
      AS DECIMAL(20,2)) AS balance_due
  FROM m_orders o LEFT JOIN m_totals t ON o.order_id = t.order_id
),
m_store AS (
  SELECT order_id, CAST(sum(amount) AS DECIMAL(20,2)) AS taken FROM m_op WHERE payment_method_id = 3 GROUP BY order_id
),
m_avail AS (
  SELECT o.order_id, c.ct_consign_id, c.customer_id, c.vendor_id, c.cash,
    CAST(coalesce(c.v_held, 0) + coalesce(c.c_held, 0) - coalesce(s.taken, 0) AS DECIMAL(20,2)) AS balance
  FROM m_orders o JOIN m_side c ON o.customer_id = c.customer_id LEFT JOIN m_store s ON o.order_id = s.order_id
),
m_position AS (
  SELECT order_id, customer_id, order_balance, gl_credit_balance, store_credit_payments,
    CAST(CASE WHEN order_balance > 0 AND gl_credit_balance - store_credit_payments > order_balance THEN order_balance
      WHEN order_balance > 0 AND gl_credit_balance - store_credit_payments < order_balance
        THEN gl_credit_balance - store_credit_payments
      ELSE 0 END AS DECIMAL(20,2)) AS apply_credit_balance,
    CAST(CASE WHEN store_credit_payments > 0 THEN gl_credit_balance - store_credit_payments END AS DECIMAL(20,2))
      AS remaining_balance
  FROM (
    SELECT d.order_id, d.customer_id, d.balance_due AS order_balance,
      CAST(coalesce(b.held, 0) + coalesce(v.v_held, 0) AS DECIMAL(20,2)) AS gl_credit_balance,
      CAST(coalesce(s.taken, 0) AS DECIMAL(20,2)) AS store_credit_payments
    FROM m_due d
      LEFT JOIN m_bal b ON b.ref = 'customer' AND b.account = 'cc' AND b.ref_id = d.customer_id
      LEFT JOIN m_side v ON v.customer_id = d.customer_id
      LEFT JOIN m_store s ON s.order_id = d.order_id
  ) x
),
m_payout AS (
  SELECT x.vendor_id, v.name, CAST(x.v_early + CASE WHEN x.c_early < 0 THEN x.c_early ELSE 0 END AS DECIMAL(20,2)) AS amount,
    CASE WHEN x.c_early < 0 THEN x.c_early END AS credit_balance,
    CASE WHEN x.c_early < 0 THEN x.customer_id END AS customer_id
  FROM m_side x JOIN m_vendors v ON x.vendor_id = v.vendor_id
  WHERE x.v_early + CASE WHEN x.c_early < 0 THEN x.c_early ELSE 0 END > 100
),
m_voucher_lines AS (
  SELECT vendor_id, CAST(vendor_id AS VARCHAR) || '-1999-01-02' AS ref_num, 1 AS line_number,
    'Consignment' AS description, 'vendor' AS ref, vendor_id AS ref_id, 'cc' AS account, 1 AS qty,
    CAST(amount - coalesce(credit_balance, 0) AS DECIMAL(20,2)) AS unit_cost FROM m_payout
  UNION ALL
  SELECT vendor_id, CAST(vendor_id AS VARCHAR) || '-1999-01-02', 2, 'Consignment - Credit Transfer', 'customer',
    customer_id, 'cc', 1, credit_balance FROM m_payout WHERE credit_balance <> 0
),
m_void AS (
  SELECT c.*, t.trans_id, t.post_date,
    CASE WHEN c.cleared THEN 'cleared' WHEN t.trans_id IS NULL THEN 'not posted' ELSE 'voidable' END AS status
  FROM m_checks c LEFT JOIN m_trans t ON t.ref = 'check' AND t.trans_id = c.check_id * 10 + 4
),
m_filled AS (
  SELECT c.ct_consign_id, c.cash, c.vendor_id, c.consign_percent,
    coalesce(c.customer_id, (SELECT max(customer_id) FROM m_customers)
      + row_number() OVER (PARTITION BY c.customer_id IS NULL AND c.vendor_id IS NOT NULL ORDER BY c.ct_consign_id))
      AS customer_id
  FROM m_consign c
),
m_repair AS (
  SELECT DISTINCT o.order_id, o.created_ts, i.invoice_id, p.customer_payment_id, p.deposit_id, p.process_ts AS payment_date
  FROM m_lines l
    JOIN m_orders o ON l.order_id = o.order_id
    JOIN m_invoices i ON i.order_id = o.order_id
    JOIN m_op p ON p.order_id = o.order_id
  WHERE l.manual_sale AND p.customer_payment_id IS NOT NULL AND p.payment_method_id = 2
),
m_staging AS (
  SELECT s_suppkey AS ct_id, s_name AS name,
    CASE WHEN s_suppkey % 21 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'CR' ELSE 'CA' END AS ctype,
    CAST(31.25 + 3.33 * (s_suppkey % 5) AS DECIMAL(6,2)) AS cper
  FROM supplier
),
m_imported AS (
  SELECT ct_id AS ct_consign_id, name, coalesce(ctype = 'CA', FALSE) AS cash,
    CAST(cper * 0.01 AS DECIMAL(5,4)) AS consign_percent FROM m_staging
),
m_fanned AS (
  SELECT ct_consign_id, name, cash, consign_percent, ct_consign_id AS item_id,
    CASE WHEN cash THEN (SELECT max(vendor_id) FROM m_vendors)
      + row_number() OVER (PARTITION BY cash ORDER BY ct_consign_id) END AS vendor_id,
    CASE WHEN NOT cash THEN (SELECT max(customer_id) FROM m_customers)
      + row_number() OVER (PARTITION BY cash ORDER BY ct_consign_id) END AS customer_id
  FROM m_imported
),
m_requests AS (
  SELECT c_custkey AS request_id, CASE WHEN c_custkey % 33 = 0 THEN c_custkey % 10
      WHEN c_custkey % 22 = 0 THEN c_custkey // 44 * 44 + 2000000 WHEN c_custkey % 11 = 0 THEN c_custkey + 2000000 END AS ct_consign_id,
    CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN c_name ELSE c_mktsegment || ', ' || c_name END AS name,
    CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 2 = 0 END AS cash,
    CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 0.4 END AS DECIMAL(5,4)) AS consign_percent,
    CAST(CASE c_custkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 0 END AS DECIMAL(10,2)) AS consign_fee
  FROM customer
),
m_valid AS (
  SELECT request_id, ct_consign_id, name, cash,
    CASE WHEN cash AND consign_fee > 0 THEN CAST(0 AS DECIMAL(5,4)) ELSE consign_percent END AS consign_percent,
    CASE WHEN cash AND consign_fee > 0 THEN consign_fee END AS consign_fee,
    concat_ws(', ', CASE WHEN name = '' THEN 'name' END, CASE WHEN cash IS NULL THEN 'account type' END,
      CASE WHEN consign_percent = 0 AND coalesce(consign_fee, 0) = 0 THEN 'percent or fee' END) AS missing
  FROM m_requests
),
m_taken AS (
  SELECT request_id, ct_consign_id,
    CASE WHEN ct_consign_id IN (SELECT ct_consign_id FROM m_consign) THEN 'id exists'
      WHEN row_number() OVER (PARTITION BY ct_consign_id ORDER BY request_id) > 1 THEN 'id asked for twice' END AS reason
  FROM m_valid WHERE missing = '' AND ct_consign_id IS NOT NULL
),
m_created AS (
  SELECT request_id, name, cash, consign_percent, consign_fee,
    CAST(coalesce(ct_consign_id, (SELECT greatest((SELECT max(ct_consign_id) FROM m_consign),
        coalesce(max(w.ct_consign_id), 0)) FROM m_valid w WHERE w.missing = '')
      + row_number() OVER (PARTITION BY ct_consign_id IS NULL ORDER BY request_id)) AS BIGINT) AS ct_consign_id
  FROM m_valid WHERE missing = '' AND request_id NOT IN (SELECT request_id FROM m_taken WHERE reason IS NOT NULL)
),
m_accounts AS (
  SELECT *, ct_consign_id AS item_id,
    CASE WHEN cash THEN (SELECT max(vendor_id) FROM m_vendors)
      + row_number() OVER (PARTITION BY cash ORDER BY ct_consign_id) END AS vendor_id,
    CASE WHEN NOT cash THEN (SELECT max(customer_id) FROM m_customers)
      + row_number() OVER (PARTITION BY cash ORDER BY ct_consign_id) END AS customer_id
  FROM m_created
),
m_merged AS (
  SELECT min(order_payment_id) AS order_payment_id, order_id, payment_method_id,
    CAST(sum(amount) AS DECIMAL(20,2)) AS amount, min(customer_payment_id) AS customer_payment_id,
    CASE WHEN count(*) = 1 THEN min(gift_card_id) END AS gift_card_id
  FROM m_op
  GROUP BY order_id, payment_method_id,
    CASE WHEN customer_payment_id IS NULL AND payment_method_id IN (2, 3, 4) THEN -1 ELSE order_payment_id END
),
m_gift_req AS (
  SELECT event_id AS request_id, event_id // 3 AS order_id, event_type,
    CASE event_id % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' ELSE props END AS name,
    CAST(value AS DECIMAL(20,2)) AS amount
  FROM events WHERE event_type IN ('signup', 'view', 'purchase') AND value <> 0
),
m_new_cards AS (
  SELECT request_id, order_id, (SELECT max(gift_card_id) FROM m_cards) + row_number() OVER (ORDER BY request_id)
    AS gift_card_id, name, amount
  FROM m_gift_req WHERE event_type = 'signup'
)
"""
