"""Parameters of the registered queries (the reference hard-codes its own)."""

# The two report years (the data spans 1995-2001), the drill-down
# country, the product search term and its page.
YEARS = (1997, 1998)
DRILL_COUNTRY = "NATION_7"
TOP_N = 10
JOINT_TOP_K = 3
SEARCH_TERM = "ring"
SEARCH_OFFSET = 10
SEARCH_PAGE = 25
SEARCH_PRICE = "9.9"
SEARCH_WORDS = '1 RING "hot r"'
