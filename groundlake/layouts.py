"""Binary layouts and code tables of the downlink packets (little-endian, packed)."""

from __future__ import annotations

#: fixed values: least payload bytes of a full packet, and most data bytes of the text packets
LEAST_BYTES = {"BEACON_BASIC": 130, "BEACON_EXTENDED": 198, "BEACON_PERIPHERAL": 1, "LOG_MESSAGE": 1, "TCMD_RESPONSE": 14, "BULK_FILE_DOWNLINK": 5}
LOG_DATA, TCMD_DATA, BULK_DATA = 199, 186, 195
#: fixed values: where the beacons' texts are: column, offset, bytes
NAME_AT, MESSAGE_AT, END_AT, STATE_AT = (1, 4), (84, 42), (126, 4), (164, 6)
#: fixed values: latest epoch milliseconds that are shown as a time (2100-01-01T01:01:01Z)
LATEST_MS = 4_102_448_461_000
PERIPHERAL_NOTE = "BEACON_PERIPHERAL struct not yet defined; raw bytes preserved"

#: fixed values: offset, struct code, column, meaning, argument
BASIC_FIELDS = (
    (0, "B", "packet_type", "enum", "PACKET_TYPE"),
    (5, "B", "active_rf_switch_antenna", "plain", None),
    (6, "B", "active_rf_switch_control_mode", "enum", "RF_SWITCH_CONTROL_MODE"),
    (7, "I", "uptime_ms", "plain", None),
    (11, "I", "duration_since_last_uplink_ms", "plain", None),
    (15, "Q", "unix_epoch_time_ms", "plain", None),
    (23, "B", "last_time_sync_source", "enum", "TIME_SYNC_SOURCE"),
    (24, "B", "is_fs_mounted", "flag", None),
    (25, "H", "total_tcmd_queued_count", "plain", None),
    (27, "H", "pending_queued_tcmd_count", "plain", None),
    (29, "I", "total_beacon_count_since_boot", "plain", None),
    (33, "B", "eps_mode", "enum", "EPS_MODE"),
    (34, "B", "eps_reset_cause", "enum", "EPS_RESET_CAUSE"),
    (35, "I", "eps_uptime_sec", "plain", None),
    (39, "H", "eps_error_code", "plain", None),
    (41, "H", "eps_battery_voltage_V", "scaled", 1000),
    (43, "B", "eps_battery_percent", "plain", None),
    (44, "h", "eps_battery_temperature_0_C", "scaled", 100),
    (46, "h", "eps_battery_temperature_1_C", "scaled", 100),
    (48, "i", "eps_total_fault_count", "plain", None),
    (52, "I", "eps_enabled_channels_bitfield", "hex", 8),
    (56, "i", "eps_total_pcu_power_input_W", "scaled", 100),
    (60, "i", "eps_total_pcu_power_output_W", "scaled", 100),
    (64, "i", "eps_total_avg_pcu_power_input_W", "scaled", 100),
    (68, "i", "eps_total_avg_pcu_power_output_W", "scaled", 100),
    (72, "i", "obc_temperature_C", "scaled", 100),
    (76, "B", "reboot_reason", "enum", "STM32_RESET_CAUSE"),
    (77, "B", "cts1_operation_state", "enum", "CTS1_OPERATION_STATE"),
    (78, "B", "rbf_pin_state", "enum", "RBF_STATE"),
    (79, "B", "mpi_rx_mode", "enum", "MPI_RX_MODE"),
    (80, "B", "mpi_transceiver_state", "enum", "MPI_TRANSCEIVER_STATE"),
    (81, "B", "mpi_last_reason_for_stopping", "enum", "MPI_STOP_REASON"),
    (82, "B", "gnss_uart_interrupt_enabled", "flag", None),
    (83, "B", "gnss_rx_mode", "enum", "GNSS_RX_MODE"),
)
#: fixed values: offset, struct code, column, meaning, argument
EXTENDED_FIELDS = (
    (130, "B", "obc_active_oscillator_MHz", "plain", None),
    (131, "h", "obc_adc_battery_voltage_V", "scaled", 1000),
    (133, "b", "mpi_last_temperature_C", "plain", None),
    (134, "h", "eps_pcu_ch0_volt_in_mppt_V", "scaled", 1000),
    (136, "h", "eps_pcu_ch0_curr_in_mppt_A", "scaled", 1000),
    (138, "h", "eps_pcu_ch0_curr_ou_mppt_A", "scaled", 1000),
    (140, "h", "eps_pcu_ch1_volt_in_mppt_V", "scaled", 1000),
    (142, "h", "eps_pcu_ch1_curr_in_mppt_A", "scaled", 1000),
    (144, "h", "eps_pcu_ch1_curr_ou_mppt_A", "scaled", 1000),
    (146, "h", "eps_pcu_ch2_volt_in_mppt_V", "scaled", 1000),
    (148, "h", "eps_pcu_ch2_curr_in_mppt_A", "scaled", 1000),
    (150, "h", "eps_pcu_ch2_curr_ou_mppt_A", "scaled", 1000),
    (152, "h", "eps_pcu_ch3_volt_in_mppt_V", "scaled", 1000),
    (154, "h", "eps_pcu_ch3_curr_in_mppt_A", "scaled", 1000),
    (156, "h", "eps_pcu_ch3_curr_ou_mppt_A", "scaled", 1000),
    (158, "H", "eps_battery_pack_status_bitfield", "hex", 4),
    (160, "h", "eps_total_avg_net_battery_power_W", "scaled", 100),
    (162, "h", "eps_total_avg_power_distributed_W", "scaled", 100),
    (170, "B", "adcs_raw_css_1", "plain", None),
    (171, "B", "adcs_raw_css_2", "plain", None),
    (172, "B", "adcs_raw_css_3", "plain", None),
    (173, "B", "adcs_raw_css_4", "plain", None),
    (174, "B", "adcs_raw_css_5", "plain", None),
    (175, "B", "adcs_raw_css_6", "plain", None),
    (176, "B", "adcs_raw_css_7", "plain", None),
    (177, "B", "adcs_raw_css_9", "plain", None),
    (178, "h", "adcs_magnetic_field_x_uT", "scaled", 100),
    (180, "h", "adcs_magnetic_field_y_uT", "scaled", 100),
    (182, "h", "adcs_magnetic_field_z_uT", "scaled", 100),
    (184, "H", "adcs_angular_rate_norm_deg_per_sec", "scaled", 100),
    (186, "h", "adcs_estimated_rate_x_deg_per_sec", "scaled", 100),
    (188, "h", "adcs_estimated_rate_y_deg_per_sec", "scaled", 100),
    (190, "h", "adcs_estimated_rate_z_deg_per_sec", "scaled", 100),
    (192, "h", "adcs_estimated_roll_angle_deg", "scaled", 100),
    (194, "h", "adcs_estimated_pitch_angle_deg", "scaled", 100),
    (196, "h", "adcs_estimated_yaw_angle_deg", "scaled", 100),
)
#: fixed values: names of codes
CODES: dict[str, dict[int, str]] = {
    "PACKET_TYPE": {1: "BEACON_BASIC", 2: "BEACON_PERIPHERAL", 3: "LOG_MESSAGE", 4: "TCMD_RESPONSE", 16: "BULK_FILE_DOWNLINK", 32: "BEACON_EXTENDED"},
    "RF_SWITCH_CONTROL_MODE": {0: "TOGGLE_BEFORE_EVERY_BEACON", 1: "FORCE_ANT1", 2: "FORCE_ANT2", 3: "USE_ADCS_NORMAL", 4: "USE_ADCS_FLIPPED", 255: "UNKNOWN"},
    "TIME_SYNC_SOURCE": {0: "NONE", 1: "GNSS_UART", 2: "GNSS_PPS", 3: "TELECOMMAND_ABSOLUTE", 4: "TELECOMMAND_CORRECTION", 5: "EPS_RTC"},
    "EPS_MODE": {0: "STARTUP", 1: "NOMINAL", 2: "SAFETY", 3: "EMERGENCY_LOW_POWER"},
    "EPS_RESET_CAUSE": {0: "POWER_ON", 1: "WATCHDOG", 2: "COMMANDED", 3: "CONTROL_SYSTEM_RESET", 4: "EMERGENCY_LOW_POWER"},
    "STM32_RESET_CAUSE": {0: "UNKNOWN", 1: "LOW_POWER_RESET", 2: "WINDOW_WATCHDOG_RESET", 3: "INDEPENDENT_WATCHDOG_RESET", 4: "SOFTWARE_RESET", 5: "EXTERNAL_RESET_PIN_RESET", 6: "BROWNOUT_RESET", 7: "OPTION_BYTE_LOADER_RESET", 8: "FIREWALL_RESET"},
    "CTS1_OPERATION_STATE": {0: "BOOTED_AND_WAITING", 1: "DEPLOYING", 2: "NOMINAL_WITH_RADIO_TX", 3: "NOMINAL_WITHOUT_RADIO_TX"},
    "RBF_STATE": {0: "BENCH", 1: "FLYING"},
    "MPI_RX_MODE": {0: "COMMAND_MODE", 1: "SENSING_MODE", 2: "NOT_LISTENING_TO_MPI"},
    "MPI_TRANSCEIVER_STATE": {0: "INACTIVE", 1: "MOSI", 2: "MISO", 3: "DUPLEX"},
    "MPI_STOP_REASON": {0: "NOT_SET", 1: "TEMPERATURE_EXCEEDED", 2: "TELECOMMAND", 3: "MAX_TIME_EXCEEDED", 4: "SELF_CHECK_DONE"},
    "GNSS_RX_MODE": {0: "COMMAND_MODE", 1: "FIREHOSE_MODE", 2: "DISABLED"},
    "ADCS_ESTIM_MODE": {0: "No attitude estimation", 1: "MEMS rate sensing", 2: "Magnetometer rate filter", 3: "Magnetometer rate filter with pitch estimation", 4: "Magnetometer and Fine-sun TRIAD algorithm", 5: "Full-state EKF", 6: "MEMS gyro EKF", 7: "User Coded Estimation Mode"},
    "ADCS_CONTROL_MODE": {0: "No control", 1: "Detumbling control", 2: "Y-Thomson spin", 3: "Y-Wheel momentum stabilized - Initial Pitch Acquisition", 4: "Y-Wheel momentum stabilized - Steady State", 5: "XYZ-Wheel control", 6: "Rwheel sun tracking control", 7: "Rwheel target tracking control", 8: "Very Fast-spin Detumbling control (10Hz)", 9: "Fast-spin Detumbling control", 10: "User Specific Control Mode 1", 11: "User Specific Control Mode 2", 12: "Stop R-wheels", 13: "User Coded Control Mode", 14: "Sun-tracking yaw- or roll-only wheel control mode", 15: "Target-tracking yaw-only wheel control mode"},
    "ADCS_RUN_MODE": {0: "Off", 1: "Enabled", 2: "Triggered", 3: "Simulation"},
    "ADCS_ASGP4_MODE": {0: "Off", 1: "Trigger", 2: "Background", 3: "Augment"},
}
#: fixed values: bits of the attitude state, by column
STATE_BITS: dict[str, dict[int, str]] = {
    "adcs_enabled": {12: "CUBECONTROL_SIGNAL", 13: "CUBECONTROL_MOTOR", 14: "CUBESENSE1", 15: "CUBESENSE2", 16: "CUBEWHEEL1", 17: "CUBEWHEEL2", 18: "CUBEWHEEL3", 19: "CUBESTAR", 20: "GPS_RECEIVER", 21: "GPS_LNA_POWER", 22: "MOTOR_DRIVER"},
    "adcs_errors": {24: "CUBESENSE1_COMMS_ERROR", 25: "CUBESENSE2_COMMS_ERROR", 26: "CUBECONTROL_SIGNAL_COMMS_ERROR", 27: "CUBECONTROL_MOTOR_COMMS_ERROR", 28: "CUBEWHEEL1_COMMS_ERROR", 29: "CUBEWHEEL2_COMMS_ERROR", 30: "CUBEWHEEL3_COMMS_ERROR", 31: "CUBESTAR_COMMS_ERROR", 32: "MAGNETOMETER_RANGE_ERROR", 35: "CAM1_SENSOR_BUSY_ERROR", 36: "CAM1_SENSOR_DETECTION_ERROR", 37: "SUN_SENSOR_RANGE_ERROR", 40: "CAM2_SENSOR_BUSY_ERROR", 41: "CAM2_SENSOR_DETECTION_ERROR", 42: "NADIR_SENSOR_RANGE_ERROR", 43: "RATE_SENSOR_RANGE_ERROR", 44: "WHEEL_SPEED_RANGE_ERROR", 45: "COARSE_SUN_SENSOR_ERROR", 46: "STAR_TRACKER_MATCH_ERROR"},
    "adcs_flags": {33: "CAM1_SRAM_OVERCURRENT", 34: "CAM1_3V3_OVERCURRENT", 38: "CAM2_SRAM_OVERCURRENT", 39: "CAM2_3V3_OVERCURRENT", 47: "STAR_TRACKER_OVERCURRENT"},
}
