"""Small survey records whose published estimates are known."""

# Tow length (nmi), large and small animals caught, per good tow.
BED_E = [
    (0.901823, 15, 0), (0.941487, 15, 1), (0.91, 8, 0), (0.918522, 6, 1), (0.897823, 19, 0), (0.930996, 40, 0),
    (0.902449, 15, 0), (0.92, 96, 0), (0.942723, 219, 0), (0.961686, 10, 0), (0.902501, 7, 0), (0.880698, 37, 0),
    (0.946866, 9, 0), (0.931059, 2, 0), (0.91345, 6, 0), (0.933655, 58, 0), (0.961088, 77, 0), (0.927001, 3, 0),
    (0.928913, 47, 1), (0.935555, 15, 0), (0.933675, 21, 1), (0.93083, 21, 0), (0.91901, 8, 0), (0.963848, 16, 0),
    (0.932884, 12, 0), (0.979302, 6, 2), (0.971416, 31, 1), (0.921711, 13, 1), (0.91767, 33, 0), (0.926483, 4, 0),
    (0.905202, None, None),
]
BED_W = [
    (0.940737, 16, 2), (0.934735, 1, 0), (0.929381, 56, 0), (0.935766, 242, 168), (0.881752, 62, 204),
    (0.903341, 11, 2), (0.928113, 15, 3), (0.905351, 335, 351), (0.925994, 609, 604), (0.920043, 68, 0),
    (0.918031, 14, 1), (0.843645, 6, 0), (0.935743, 7, 1), (0.95, 3, 0), (0.921119, 4, 0), (0.921778, 317, 0),
]
AREAS = [("E", 89.11, 88), ("W", 48.66, 48)]

# N, dbar, var_dbar, cv, ss, total, var_total, cv_total by bed and class.
EXPECTED = {
    ("E", "large"): (31, 27494.448206699457, 1656998330.9398148, 148.05259617067782, 49709949928.19444,
                     2450030.2796989884, 424437027624.9638, 26.591031251082732),
    ("E", "small"): (31, 249.5817499745599, 243425.30228290128, 197.68332328433993, 7302759.068487039,
                     22240.229742460782, 62352936.524119936, 35.50497298414046),
    ("E", "all"): (31, 27744.029956699014, 1652173880.7367787, 146.50698510953785, 49565216422.10336,
                   2472270.5094414493, 423201253716.2841, 26.313431309630758),
    ("W", "large"): (16, 109720.44902182026, 30127065682.086937, 158.19430356747617, 451905985231.3041,
                     5338997.049401773, 4458420847684.777, 39.54857589186905),
    ("W", "small"): (16, 83534.44466104246, 29487316106.43256, 205.56635392545618, 442309741596.4884,
                     4064786.077206326, 4363746083288.7583, 51.391588481364046),
    ("W", "all"): (16, 193254.89368286272, 110989129713.73332, 172.38906846944337, 1664836945705.9998,
                   9403783.1266081, 16424973311500.434, 43.097267117360836),
}
# Sums of counts with their range by bed, over tows with a catch.
EXPECTED_CATCH = {"W": (1766, 1336, 1, 609, 0, 604)}

# Fixed values, as printed: bed, year, area, cells, tows, means and variances per mile, and what follows from them.
POPULATION = [
    dict(bed="East", year=1998, sq_nm=79.0, big_n=78, n=28, mean_count=88.14, mean_wt=20.5, var_count=5593.40,
         var_wt=327.24, pop_count=5288624, var_cbar_count=128.05, var_pop_count=461002394976.62, ci_mean_count=23,
         ci_pop_count=1393135, cv_count=0.13, area_swept=0.036866, density=0.020, mr_rate=0.073),
    dict(bed="North", year=1998, sq_nm=90.2, big_n=88, n=10, mean_count=245.62, mean_wt=85.3, var_count=47920.29,
         var_wt=5540.64, pop_count=16826555, var_cbar_count=4247.48, var_pop_count=19934253178918.40,
         ci_mean_count=147, ci_pop_count=10100032, cv_count=0.27, area_swept=0.013167, density=0.054, mr_rate=0.071),
    dict(bed="West", year=1998, sq_nm=48.7, big_n=48, n=21, mean_count=172.56, mean_wt=33.9, var_count=50976.83,
         var_wt=2193.60, pop_count=6382639, var_cbar_count=1365.45, var_pop_count=1868054366759.61, ci_mean_count=77,
         ci_pop_count=2851028, cv_count=0.21, area_swept=0.02765, density=0.038, mr_rate=0.084),
    dict(bed="East", year=2012, sq_nm=79.0, big_n=78, n=19, mean_count=66.63, mean_wt=13.4, var_count=8112.96,
         var_wt=394.30, pop_count=3997740, var_cbar_count=322.99, var_pop_count=1162767338207.63, ci_mean_count=38,
         ci_pop_count=2265460, cv_count=0.27, area_swept=0.025016, density=0.015, mr_rate=0.071),
]
RECOVERY = [
    ("NORTH", "K 1998", 16.329325, 1.246987), ("WEST", "K 1998", 14.968548, 1.3), ("WEST", "K 1998", 34.47302, 2.85),
    ("EAST", "K 1998", 55.338269, 3.95), ("EAST AND WEST", "K 1998", 26.308357, 1.9),
    ("EAST", "K 1998", 43.544867, 3.25), ("NORTH", "K 1998", 15.42214, 1.077281), ("NORTH", "K 1998", 48.987975, 3.401942),
    ("EAST", "K 2012", 27.39, 2.499), ("EAST", "K 2012", 45.99, 2.903), ("EAST", "K 2012", 5.25, 0.204),
]
