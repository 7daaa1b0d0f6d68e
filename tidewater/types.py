"""Schemas of raw facts and of normalised products, as DDL."""

_TEXT_OR_NUMBER = "string"

#: Loosely extracted facts; amounts may be text.
RAW = f"""
product struct<insurer:string,planName:string,variant:string,uin:string,policyType:string,isTopUp:boolean,geography:string>,
sumInsured struct<baseSI:{_TEXT_OR_NUMBER},currency:string,bands:array<{_TEXT_OR_NUMBER}>,unlimitedOneClaim:boolean>,
deductible struct<applies:boolean,type:string,amount:{_TEXT_OR_NUMBER},aggregateApplies:boolean>,
roomRent struct<text:string,icuText:string,addonInfo:string,upgradeOption:boolean>,
hospitalization struct<inpatientCovered:boolean,daycare:string,preHospDays:{_TEXT_OR_NUMBER},postHospDays:{_TEXT_OR_NUMBER},
  domiciliary:struct<covered:boolean,minDays:{_TEXT_OR_NUMBER},negativeListPresent:boolean,notes:string>,ayushText:string,ayushLimitValue:{_TEXT_OR_NUMBER}>,
transport struct<roadAmbulanceLimit:{_TEXT_OR_NUMBER},airAmbulance:string,airAmbulanceLimit:{_TEXT_OR_NUMBER}>,
organDonor struct<covered:boolean,notes:string>,
bonuses struct<ncbText:string,rechargeText:string>,
waitingPeriods struct<initialDays:{_TEXT_OR_NUMBER},specificAilmentsMonths:{_TEXT_OR_NUMBER},pedMonths:{_TEXT_OR_NUMBER},reductionSpecific:boolean,reductionPed:boolean>,
copay struct<mandatoryType:string,mandatoryPercent:{_TEXT_OR_NUMBER},optionalAvailable:boolean>,
sublimits struct<cataractText:string,diseaseSpecific:array<struct<name:string,type:string,value:{_TEXT_OR_NUMBER}>>>,
valueAdds struct<annualHealthCheckup:boolean,eConsult:boolean,wellnessBenefits:boolean,others:array<string>>,
topUpSpecifics struct<howDeductibleApplies:string,coverageList:array<string>,roomRule:string,recharge:string,ncb:string>,
provenance struct<sourceType:string,sourceName:string,sourceDate:string,extractionConfidence:double>,
notes array<string>
""".replace("\n", " ")

#: A typed product.
PRODUCT = """
product struct<insurer:string,planName:string,variant:string,uin:string,policyType:string,isTopUp:boolean,geography:string>,
sumInsured struct<baseSI:double,currency:string,availableBands:array<double>,unlimitedOneClaim:boolean>,
deductible struct<applies:boolean,type:string,amount:double,aggregateApplies:boolean>,
roomRent struct<limitType:string,limitValue:double,icuLimitType:string,icuLimitValue:double,proportionateDeduction:string,roomModifierOption:boolean>,
hospitalization struct<inpatient:string,daycare:string,preHospDays:double,postHospDays:double,
  domiciliary:struct<covered:boolean,minDays:double,negativeListPresent:boolean,notes:string>,ayush:struct<covered:boolean,limitType:string,limitValue:double>>,
transport struct<roadAmbulanceLimit:double,airAmbulance:string,airAmbulanceLimit:double>,
organDonor struct<covered:boolean,notes:string>,
bonuses struct<ncb:struct<accrualPerYearPercent:double,maxCapPercent:double,claimImpact:string>,recharge:struct<type:string,sameIllnessAllowed:boolean>>,
waitingPeriods struct<initialDays:double,specificAilmentsMonths:double,pedMonths:double,reductionOptions:struct<specificAilments:boolean,ped:boolean>>,
copayAndZones struct<mandatory:string,mandatoryPercent:double,optionalCopayAvailable:boolean>,
sublimits struct<cataract:struct<type:string,value:double,perEye:boolean>,diseaseSpecific:array<struct<name:string,type:string,value:double>>>,
valueAdds struct<annualHealthCheckup:boolean,eConsult:boolean,wellnessBenefits:boolean,others:array<string>>,
topUpSpecifics struct<howDeductibleApplies:string,coverageAboveDeductible:array<string>,roomRuleOnTopUp:string,rechargeOnTopUp:string,ncbOnTopUp:string>,
provenance struct<sourceType:string,sourceName:string,sourceDate:string,extractionConfidence:double>,
notes string
""".replace("\n", " ")
