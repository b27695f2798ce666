SELECT entity, period, model, ap_micro FROM client_ap
