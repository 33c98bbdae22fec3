"""Declared schemas of the survey files. Column names are fixed by the file formats."""

# Names and types of the survey's input columns.
HAULS = """
    YEAR INT, PROJECT_CODE STRING, EVENT_ID STRING, DISTRICT STRING, DREDGE_ID STRING, BED_SW STRING,
    STATION_TYPE STRING, STATION_ID STRING, DATE_SET STRING, START_LATITUDE DOUBLE, START_LONGITUDE DOUBLE,
    DEPTH_START_F DOUBLE, START_TIME STRING, TOW_SPEED DOUBLE, Max_Dpth_fa DOUBLE, Min_Dpth_fa DOUBLE,
    END_LATITUDE DOUBLE, END_LONGITUDE DOUBLE, DEPTH_END_F DOUBLE, END_TIME STRING, TOW_LENGTH_CALC DOUBLE,
    TOW_LENGTH_FIELD DOUBLE, TOW_LENGTH_DESIGNATED DOUBLE, GEAR_PERFORMANCE_CODE_SW INT, VESSEL_NAME STRING
"""
CATCH = """
    EVENT_ID STRING, RACE_CODE INT, SCAL_SIZE_CLASS INT, COUNT BIGINT, SAMPLE_WT_KG DOUBLE,
    CONDITION_CODE_RII INT, SAMPLE_TYPE INT
"""
INDIVIDUALS = """
    EVENT_ID STRING, RACE_CODE INT, SCALLOP_NUMBER INT, SCAL_SIZE_CLASS INT, WHOLE_WT_GRAMS DOUBLE,
    SHELL_WORM_SW INT, SHELL_HEIGHT_MM DOUBLE, SEX_SW INT, SCAL_GONAD_COND INT, MUD_BLISTER_SW INT,
    MEAT_CONDITION_SW INT, MEAT_WEIGHT_GRAMS DOUBLE, CLAPPER INT, SAMPLE_TYPE INT
"""
AREAS = "Bed STRING, area_nm2 DOUBLE, grids INT"
LONG_TERM_HAULS = """
    YEAR INT, PROJECT_CODE STRING, EVENT_ID STRING, SURVEY_AREA STRING, BED STRING, STATION_ID STRING,
    TOW_LENGTH_FIELD DOUBLE, TOW_LENGTH_DESIGNATED DOUBLE, USED_IN_ESTIMATE STRING
"""
LONG_TERM_CATCH = "EVENT_ID STRING, SPECIES_CODE INT, CONDITION_CODE INT, COUNT BIGINT, SAMPLE_WT_KG DOUBLE"
STATIONS = """
    RECORD_ID BIGINT, FK_PROJECT_CODE STRING, STATION_ID STRING, SURVEY_AREA STRING, STANDARD_STATION STRING,
    BED STRING, Area_Sq_NM DOUBLE, Area_Sq_Km DOUBLE, Color STRING, Centroid_Lat_DD DOUBLE,
    Centroid_Long_DD DOUBLE, sqnm_alb DOUBLE, sqnm_utm DOUBLE
"""
RECOVERY = "BED STRING, SURVEY_AND_YEAR STRING, WHOLE_WT_KG DOUBLE, MEAT_WT_KG DOUBLE"
T_TABLE = "n BIGINT, df BIGINT, t90 DOUBLE, t95 DOUBLE, t99 DOUBLE"
T_TABLE_FILE = "ID BIGINT, N BIGINT, df BIGINT, `90_2tail` DOUBLE, `95_2tail` DOUBLE, `99_2tail` DOUBLE"

# Output names of the haul projection: {new name: file column}.
HAUL_COLUMNS = {
    "event": "EVENT_ID",
    "district": "DISTRICT",
    "dredge": "DREDGE_ID",
    "bed": "BED_SW",
    "type": "STATION_TYPE",
    "slat": "START_LATITUDE",
    "slon": "START_LONGITUDE",
    "sdepth": "DEPTH_START_F",
    "stime": "START_TIME",
    "speed": "TOW_SPEED",
    "maxdepth": "Max_Dpth_fa",
    "mindepth": "Min_Dpth_fa",
    "elat": "END_LATITUDE",
    "elon": "END_LONGITUDE",
    "edepth": "DEPTH_END_F",
    "etime": "END_TIME",
    "calc_length": "TOW_LENGTH_CALC",
    "field_length": "TOW_LENGTH_FIELD",
    "length": "TOW_LENGTH_DESIGNATED",
    "performance": "GEAR_PERFORMANCE_CODE_SW",
    "vessel": "VESSEL_NAME",
}
CATCH_COLUMNS = {
    "event": "EVENT_ID",
    "species": "RACE_CODE",
    "size_class": "SCAL_SIZE_CLASS",
    "count": "COUNT",
    "sample_wt": "SAMPLE_WT_KG",
    "cond": "CONDITION_CODE_RII",
    "sample_type": "SAMPLE_TYPE",
}
INDIVIDUAL_COLUMNS = {
    "event": "EVENT_ID",
    "species": "RACE_CODE",
    "number": "SCALLOP_NUMBER",
    "size_class": "SCAL_SIZE_CLASS",
    "weight": "WHOLE_WT_GRAMS",
    "worm": "SHELL_WORM_SW",
    "height": "SHELL_HEIGHT_MM",
    "sex": "SEX_SW",
    "gonad_cond": "SCAL_GONAD_COND",
    "blister": "MUD_BLISTER_SW",
    "meat_cond": "MEAT_CONDITION_SW",
    "meat_weight": "MEAT_WEIGHT_GRAMS",
    "clapper": "CLAPPER",
    "sample_type": "SAMPLE_TYPE",
}
