"""Unit constants. Variants of one quantity differ in print precision and are not interchangeable."""

# Fixed values.
POUNDS_PER_GRAM = 0.00220462
POUNDS_PER_KG_SHORT = 2.2046
POUNDS_PER_KG_LONG = 2.20462262
GRAMS_PER_POUND = 453.592
GRAMS_PER_KG = 1000
DREDGE_WIDTH_NMI = 0.00131663
DREDGE_WIDTH_NMI_LONG = 0.001316656
DREDGE_EFFICIENCY = 0.83
FEET_PER_NMI = 6076
DREDGE_WIDTH_FEET = 8
SQUARE_METRES_PER_SQUARE_NMI = 3429904
HARVEST_RATES = (0.05, 0.10)
INTERVAL_PROBS = (0.025, 0.975)
DESIGN_FRACTIONS = (0.2, 0.3, 0.35, 0.4, 0.5)
REPLICATES = 1000
