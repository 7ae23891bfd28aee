"""Schemas of the JSON documents the readers accept."""
WORD = "struct<word:string,start:double,end:double,confidence:double>"
SEGMENT = f"struct<start:double,end:double,speaker_id:string,text:string,confidence:double,words:array<{WORD}>>"
CANDIDATE = (f"session_id string, candidate_id string, asr_data struct<provider:string,model_name:string,decode_mode:string,processing_time:double,"
             f"text:string,words:array<{WORD}>>, aligned_segments array<{SEGMENT}>, confidence_scores struct<D_diarization:double,"
             "A_asr_alignment:double,L_linguistic:double,R_agreement:double,O_overlap:double,final_score:double>")
GOLD = ("test_id string, audio_duration double, segments array<struct<start:double,end:double,speaker:string,text:string,confidence:double>>, "
        "quality_targets struct<der_expected:double,wer_expected:double>")
HISTORY = "timestamp timestamp, gate_results array<struct<test_id:string,gate_type:string,measured_value:double>>"
CALL_EVENT = "event_id bigint, ts timestamp, service string, event string, attempt bigint, duration_ms double, error string"
METRIC_EVENT = "event_id bigint, ts timestamp, name string, component string, value double"
MASTER = ("session_id string, metadata struct<version:string,total_duration:double,total_segments:bigint,speaker_count:bigint>, speaker_map map<string,string>, "
          "provenance struct<candidate_id:string>, segments array<struct<ordinal:bigint,start:double,end:double,speaker:string,speaker_id:string,text:string,confidence:double>>")
