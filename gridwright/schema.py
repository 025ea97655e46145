"""Constants of the domain; fixed values that results depend on."""

# Coverage geometry.
FACADE_FRACTIONS = (0.05, 0.5, 0.9)
COVERED_SHARE = 1 / 3
FRESNEL_CLEARANCE = 0.6
LIGHT_M_US = 299.792458
MIN_SAMPLE_Z = 1.5
TERRAIN_SAMPLES = 24

# Transport topology.
HUB_FRACTION, RELAY_FRACTION, HUB_SPACING = 0.20, 0.33, 2.0
REACH_M, CLEARANCE_M, PROFILE_SAMPLES = 1400.0, 5.0, 32
BATTERY_S = {"hub": 28800.0, "relay": 14400.0, "edge": 3600.0}

# People in buildings.
STOREY_M, SIM_FACTOR, DEFAULT_OCCUPANCY = 3.2, 1.25, 0.016
OCCUPANCY = {
    "apartments": 0.014, "residential": 0.014, "house": 0.010, "dormitory": 0.020, "hotel": 0.016,
    "office": 0.040, "commercial": 0.036, "retail": 0.030, "supermarket": 0.026, "mall": 0.033,
    "hospital": 0.022, "school": 0.026, "university": 0.028, "civic": 0.020, "government": 0.024,
    "train_station": 0.045, "industrial": 0.007, "warehouse": 0.004, "parking": 0.001, "roof": 0.0,
    "garage": 0.001, "garages": 0.001, "shed": 0.0, "hut": 0.0, "yes": 0.016,
}
CRITICAL_AMENITIES = ("hospital", "clinic", "doctors", "fire_station", "police", "bus_station", "ambulance_station")
CRITICAL_KINDS = ("hospital", "train_station", "transportation")

# Roads and flooding.
SPEED_KMH = {
    "motorway": 70.0, "trunk": 55.0, "primary": 45.0, "secondary": 38.0, "tertiary": 32.0, "unclassified": 28.0,
    "residential": 22.0, "living_street": 12.0, "service": 14.0, "motorway_link": 45.0, "trunk_link": 38.0,
    "primary_link": 32.0, "secondary_link": 28.0, "tertiary_link": 25.0,
}
POSTED_KMH = (5.0, 130.0)
DEFAULT_SPEED_KMH, JUNCTION_S, NODE_SNAP_M, MAX_SNAP_M = 25.0, 4.0, 0.5, 250.0
IMPASSABLE_M, WADING_FACTOR, FLAT_DEM_M, FLOOD_SLOWDOWN = 0.5, 40.0, 0.5, 3.2

# Rain and radio.
RAIN_K, RAIN_ALPHA, LINK_MARGIN_DB, CLEAR_SNR_DB = 0.0691, 1.0818, 35.0, 30.0
FLOOD_RAIN_MM, EDGE_SHARE = 30.0, 0.25

# Alarm clustering.
EPS_M, EPS_S, MIN_PTS, RETENTION_S, JACCARD_REUSE = 900.0, 600.0, 2, 1800.0, 0.5

# Edge detector.
METRICS = ("rssi_dbm", "throughput_mbps", "temperature_c", "power_draw_w", "vswr", "packet_loss_pct")
WARMUP, ALPHA, Z_LIMIT, CONFIRM, DISTANCE_LIMIT, DISTANCE_SOFT, CONFIRM_PERIOD = 80, 0.002, 4.0, 3, 6.5, 4.5, 20
MIN_THROUGHPUT, MAX_LOSS, VAR_FLOOR = 1.0, 60.0, 1e-6
BASELINE = {
    "rssi_dbm": (-68.0, 0.8), "throughput_mbps": (420.0, 12.0), "temperature_c": (42.0, 0.6),
    "power_draw_w": (610.0, 8.0), "vswr": (1.18, 0.02), "packet_loss_pct": (0.15, 0.05),
}
PROFILES = {
    "amplifier_degradation": {"temperature_c": ("+", 34.0), "power_draw_w": ("*", 1.45), "throughput_mbps": ("*", 0.35), "vswr": ("*", 2.4), "packet_loss_pct": ("+", 7.5), "rssi_dbm": ("+", -9.0)},
    "power_failure": {"throughput_mbps": ("*", 0.0), "power_draw_w": ("*", 0.05), "packet_loss_pct": ("+", 99.0), "rssi_dbm": ("+", -45.0), "temperature_c": ("+", -14.0)},
    "backhaul_congestion": {"throughput_mbps": ("*", 0.22), "packet_loss_pct": ("+", 14.0)},
    "antenna_misalignment": {"rssi_dbm": ("+", -16.0), "vswr": ("*", 3.1), "throughput_mbps": ("*", 0.55)},
}
BOUNDS = {
    "rssi_dbm": (-125.0, -30.0), "throughput_mbps": (0.0, 1200.0), "temperature_c": (-10.0, 130.0),
    "power_draw_w": (0.0, 1500.0), "vswr": (1.0, 12.0), "packet_loss_pct": (0.0, 100.0),
}

# Priorities, dispatch and indicators.
SEVERITY = {"degraded": 0.45, "down": 1.0}
CRITICAL_EXTRA, SLA_MIN = 2.5, 60.0
DETOUR_S, PREEMPT, REPAIR_S, DEFAULT_REPAIR_S = 300.0, 1.35, {"degraded": 1200.0, "down": 2100.0}, 1800.0
RAW_BYTES, EVENT_BYTES, FUEL_L_KM, CO2_KG_L = 120, 180, 0.11, 2.68
ANNUAL_SITES, ANNUAL_RATE = 2000, 4.0
HIGH_BAND, MEDIUM_BAND, NOMINAL_SUBSCRIBERS = 75.0, 45.0, 12000.0
HIGH_SHARE, MEDIUM_SHARE = 0.90, 0.67
RISK_FEATURES = (
    "asset_age_years", "days_since_maintenance", "recent_thermal_cycles", "peak_temperature_c", "vswr_trend_30d", "load_factor", "subscribers_served",
    "terrain_slope_deg", "elevation_m", "antenna_height_m", "rainfall_intensity_mm_hr", "lightning_density_per_km2", "humidity_pct", "encroachment_risk",
)
DIGEST_S, EVENT_TAIL = 10.0, 40
EARTH_M = 6_371_000.0
