"""Small tables used by several tests: sales of a few cards, out of order, with gaps."""

from __future__ import annotations

BASIC_SCHEMA = (
    "TransactionID long, TransactionDT long, TransactionAmt double, ProductCD string, card1 long, card2 double, "
    "addr1 long, addr2 long, P_emaildomain string, R_emaildomain string, DeviceType string, isFraud int"
)
BASIC = [
    (31, 700, 4.25, "H", 9, 77.0, 330, 60, "mail.test", None, "tablet", 0),
    (27, 350, 18.75, "H", 8, 66.0, 340, 60, "post.test", None, "tablet", 0),
    (22, 150, 61.0, "S", 8, 66.0, 340, 60, "mail.test", None, None, 1),
    (24, 210, None, "H", 5, None, 310, 60, None, None, None, 0),
    (21, 120, 33.5, None, 9, 77.0, 330, 60, "mail.test", None, None, 0),
    (29, 510, 7.0, "S", 6, 55.0, 320, 60, "post.test", None, None, 0),
    (25, 260, 90.1, "R", 9, 77.0, 330, 60, "mail.test", None, "tablet", 1),
    (28, 430, 2.0, "H", 5, 44.0, 310, 60, "post.test", None, None, 0),
    (32, 820, 75.0, "S", 6, 55.0, 320, 60, "mail.test", None, None, 0),
    (26, 300, 12.4, "R", 4, 33.0, 350, 60, "mail.test", None, None, 0),
    (30, 640, 55.6, None, 4, 33.0, 350, 60, "mail.test", None, None, 1),
    (23, 180, 21.0, "H", 9, 77.0, 330, 60, "post.test", None, "tablet", 0),
]

HISTORY_SCHEMA = (
    "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, card2 long, addr1 long, addr2 long, "
    "D1 double, D4 double, D10 double, D15 double, ProductCD string, P_emaildomain string, R_emaildomain string, "
    "DeviceType string, DeviceInfo string, id_30 string, id_31 string, isFraud int"
)
HISTORY = [
    (11, 1000, 8.0, 55, 5, 70, 3, 0.0, 2.0, 0.0, None, "H", "x.test", "y.test", "tablet", "Pad 9", "Android 12", "firefox 110", 0),
    (12, 1450, 31.0, 66, 6, 80, 3, 3.0, 3.0, None, 3.0, "S", None, None, None, "Box", "Linux", "Edge 99", 1),
    (13, 1600, 24.0, 55, 5, 70, 3, 0.0, 2.0, 0.0, 0.0, "H", "z.test", "y.test", "tablet", "Pad 9", "Android 12", "firefox 110", 0),
    (14, 2300, 14.0, 66, 6, 80, 3, 3.0, 4.0, 3.0, 3.0, "S", None, None, None, "Box", "Linux", "Edge 99", 0),
    (15, 2950, 48.0, 55, 5, 70, 3, 0.0, 0.0, 0.0, 0.0, "R", "x.test", "y.test", "tablet", "Pad 10", "Android 13", "firefox 111", 0),
    (16, 3100, 5.5, 55, 5, 90, 3, 0.0, 1.0, 0.0, 0.0, "R", "x.test", None, None, None, None, None, 1),
    (17, 3900, 19.0, 77, 7, 60, 3, 1.0, 1.0, 1.0, 1.0, "H", "x.test", None, None, None, None, None, 0),
]


def basic(spark):
    return spark.createDataFrame(BASIC, BASIC_SCHEMA)


def history(spark):
    return spark.createDataFrame(HISTORY, HISTORY_SCHEMA)
