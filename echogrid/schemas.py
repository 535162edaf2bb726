"""Explicit schemas of the wire messages and stored tables (DDL text)."""

ENVELOPE = "schema_version int, device_id string, tenant_id string, ts timestamp, seq bigint, kind string"
PRESENCE_FIELDS = (
    "state string, mv_current double, wander_current double, mv_threshold double, wander_baseline double, "
    "wander_ratio_threshold double, wander_ratio double, wander_confirmed boolean, last_activity_at double, "
    "seconds_since_activity double, just_changed boolean"
)
PRESENCE = f"{ENVELOPE}, tick_uptime_s double, {PRESENCE_FIELDS}"
SIGNAL = (
    f"{ENVELOPE}, encoding string, signal_b64 string, signal_len int, fs_hz double, window_samples int, window_span_s double, "
    "selected_subcarrier_count int, selected_stream_count int, selected_pc_indices string, candidate_pc_count int, "
    "selected_pc_count int, input_frames int, input_subcarriers int, signal_q double, presence_state string, gate_reason string"
)
TELEMETRY = (
    f"{ENVELOPE}, link struct<connected:boolean,transport:string,frames_ok:bigint,checksum_errors:int,resyncs:int,hz_1s:double,rssi:double>, "
    "gate_open boolean, signals_published bigint, signals_gated bigint, fw_version string, edge_version string, uptime_s double"
)
ACK = f"{ENVELOPE}, cmd_id string, status string, progress double, result map<string,string>"
RECEIPT = "schema_version int, received_at timestamp, source_topic string, tenant_id string, device_id string, payload string"
INFERENCE = (
    "tenant_id string, device_id string, ts timestamp, seq bigint, proba_fall double, threshold double, postprocess string, "
    "inferred_at timestamp, feature_ms double, infer_ms double, model_version string"
)
# One table row holds exactly the wire fields: envelope keys plus the eleven status fields.
PRESENCE_SAMPLES = f"ts timestamp, tenant_id string, device_id string, {PRESENCE_FIELDS}"
BY_KIND = {"presence": PRESENCE, "signal": SIGNAL, "telemetry": TELEMETRY, "ack": ACK}
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
